"""Accounting of a bounded first-in-first-out queue, replayed from a log of calls."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many wait at most, how long a batch may be out, how long an item may wait.
CAPACITY, BATCH_S, ITEM_S = 1_000_000, 600.0, 86_400.0


class Queue:
    """Items go out in order, in batches; a batch that fails or stays out too long comes back first in line."""

    def __init__(self, capacity: int = CAPACITY, batch_s: float = BATCH_S, item_s: float = ITEM_S):
        self.capacity, self.batch_s, self.item_s = capacity, batch_s, item_s
        self.waiting: deque[tuple[float, int]] = deque()
        self.out: OrderedDict[int, tuple[float, list[tuple[float, int]]]] = OrderedDict()
        self.taken = self.dropped = self.expired = self.done = self.back = 0

    def tick(self, now: float) -> None:
        while self.out and now - next(iter(self.out.values()))[0] > self.batch_s:
            self.fail(next(iter(self.out)))
        while self.waiting and now - self.waiting[0][0] > self.item_s:
            self.waiting.popleft()
            self.expired += 1

    def enqueue(self, now: float, item: int) -> None:
        """A full queue drops what comes last."""
        if len(self.waiting) >= self.capacity:
            self.dropped += 1
        else:
            self.waiting.append((now, item))

    def dequeue(self, now: float, batch: int, most: int) -> int:
        items = [self.waiting.popleft() for _ in range(min(most, len(self.waiting)))]
        if items:
            self.out[batch] = (now, items)
            self.taken += len(items)
        return len(items)

    def complete(self, batch: int) -> None:
        if batch in self.out:
            self.done += len(self.out.pop(batch)[1])

    def fail(self, batch: int) -> None:
        if batch in self.out:
            items = self.out.pop(batch)[1]
            self.waiting.extendleft(reversed(items))
            self.back += len(items)


def replay(calls: DataFrame, capacity: int = CAPACITY, batch_s: float = BATCH_S, item_s: float = ITEM_S) -> DataFrame:
    """Totals of each queue's calls: ``queue, waiting, out, taken, done, dropped, expired, back``.

    ``calls``: ``queue, t`` (seconds), ``call`` (enqueue, dequeue, complete,
    fail), ``id`` (item or batch), ``n`` (batch size).  Every call depends on those
    before, so a queue is replayed in order (of time, then id) within one task;
    calls come sorted and pass through in batches, so a task holds what waits in
    one queue, never its calls.
    """
    names = ["queue", "waiting", "out", "taken", "done", "dropped", "expired", "back"]

    def result(name: str, q: Queue) -> pa.RecordBatch:
        numbers = [len(q.waiting), sum(len(x[1]) for x in q.out.values()), q.taken, q.done, q.dropped, q.expired, q.back]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *(pa.array([x], pa.int64()) for x in numbers)], names=names)

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, q = None, None
        for part in parts:
            for queue, t, call, id_, n in zip(*(part.column(i).to_pylist() for i in range(5))):
                if q is None or queue != name:
                    if q is not None:
                        yield result(name, q)
                    name, q = queue, Queue(capacity, batch_s, item_s)
                q.tick(t)
                if call == "enqueue":
                    q.enqueue(t, id_)
                elif call == "dequeue":
                    q.dequeue(t, id_, n)
                elif call == "complete":
                    q.complete(id_)
                elif call == "fail":
                    q.fail(id_)
        if q is not None:
            yield result(name, q)

    narrow = calls.select(F.col("queue").cast("string"), F.col("t").cast("double"), F.col("call").cast("string"), F.col("id").cast("long"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n")).where("t is not null")
    return narrow.repartition("queue").sortWithinPartitions("queue", "t", "id").mapInArrow(walk, ", ".join([f"{names[0]} string", *(f"{n} long" for n in names[1:])]))
