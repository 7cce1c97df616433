"""A paged log as a streaming source: sizes are asked for, ranges are claimed, each range is a task.

    spark.dataSource.register(PagedLog)
    spark.readStream.format("paged_log").option("logs", "https://a,https://b").option("page", 256).load()

A log answers ``<base>/get-sth`` with ``tree_size`` and
``<base>/get-entries?start=..&end=..`` with ``entries``; a base without a scheme
is a folder that holds files of these names, as on shared storage in tests.
"""

from __future__ import annotations

import json
import os
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "log string, idx long, leaf_input string"


def fetch(base: str, call: str, timeout: float = 30.0) -> dict:
    if "://" not in base:
        with open(os.path.join(base, call), encoding="utf-8") as file:
            return json.load(file)
    with urllib.request.urlopen(f"{base}/{call}", timeout=timeout) as answer:  # noqa: S310 - the caller names the logs
        return json.load(answer)


class Range(InputPartition):
    def __init__(self, base: str, start: int, end: int):
        self.base, self.start, self.end = base, start, end


class PagedLogReader(DataSourceStreamReader):
    """Offsets are the next index of each log; a trigger takes at most ``most`` pages of a log."""

    def __init__(self, options: dict):
        self.logs = [x.strip() for x in options["logs"].split(",") if x.strip()]
        self.page, self.most = int(options.get("page", 256)), int(options.get("most", 64))
        self.begin = int(options.get("begin", 0))
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.logs, self.begin)

    def latestOffset(self) -> dict:
        for base in self.logs:
            at = self.reached.get(base, self.begin)
            size = int(fetch(base, "get-sth")["tree_size"])
            # whole pages only, so that a range that is read again has the same rows
            self.reached[base] = min(at + self.page * self.most, max(at, size - size % self.page))
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for base in self.logs:
            low, high = int(start.get(base, self.begin)), int(end.get(base, self.begin))
            self.reached[base] = max(self.reached.get(base, self.begin), high)
            out += [Range(base, at, min(at + self.page, high)) for at in range(low, high, self.page)]
        return out

    def read(self, partition: Range):
        answer = fetch(partition.base, f"get-entries?start={partition.start}&end={partition.end - 1}")
        for i, entry in enumerate(answer["entries"]):
            yield partition.base, partition.start + i, entry["leaf_input"]


class PagedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PagedLogReader:
        return PagedLogReader(self.options)
