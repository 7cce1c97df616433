"""Rule data and the notation it is written in.

A line reads ``Name: a, b + c``: the name holds where any of the alternatives
between commas does, an alternative where all its parts between plus signs occur.
"""

from __future__ import annotations

Rules = list[tuple[str, list[list[str]]]]


def parse(text: str) -> Rules:
    """Rules of a text, a line each; blank lines and ``#`` comments are skipped."""
    out: Rules = []
    for line in map(str.strip, text.strip().splitlines()):
        if line and not line.startswith("#"):
            name, _, patterns = line.partition(": ")
            out.append((name, [[p.strip().lower() for p in x.split(" + ")] for x in patterns.split(", ")]))
    return out


def read(spark, path: str) -> Rules:
    """Rules of one's own, from a text file in the same notation (a rule set is small by nature)."""
    return parse("\n".join(r.value for r in spark.read.text(path).collect()))
