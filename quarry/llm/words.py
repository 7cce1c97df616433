"""Words of many texts at once: Arrow splits and dictionary-encodes, Python sees distinct words only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together until they hold this many bytes.
GROUP_BYTES = 12 << 20


def groups(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """Join small batches, and cut large ones, into tables of about ``size`` bytes of text; a longer text stands alone."""
    held, bytes_held = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), max(size - bytes_held, 0), side="right")))
            held.append(batch.slice(at, n))
            bytes_held += int(lengths[at : at + n].sum())
            at += n
            if bytes_held >= size or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, bytes_held = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of each word, offset of each text's words, the distinct words) with words split at ASCII white space.

    Text ``i`` has the codes from ``offsets[i]`` to ``offsets[i + 1]``; the empty
    word may be among the distinct ones, where white space begins or ends a text.
    """
    flat = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
    lists = pc.ascii_split_whitespace(pc.fill_null(flat, "").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = pc.dictionary_encode(lists.flatten())
    return coded.indices.to_numpy().astype(np.int64), offsets, coded.dictionary.cast(pa.large_binary()).to_pylist()
