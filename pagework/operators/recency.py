"""Which files an owner opened last, with counts that start again where a file fell out in between.

A file falls out when ``keep`` other files were opened since; opened again, it starts at 1. Opens are read in order of time, and
those of one instant from the last path to the first, as the cap keeps the first. A stretch of an owner's opens is summed up in two
lists of at most ``keep`` paths, however long it is:

* ``first``: its paths in the order of their first open. Where the list is full, every path that is not on it has ``keep`` others before
  it in the stretch;
* ``recent``: the paths opened last, the latest at the end, each with its count, its last open, and whether the count goes back to the
  stretch's first open of that path without a break.

Two neighbouring stretches make one of the same form (``join``), so a busy owner's opens are read by many tasks at once, and an
index that was kept stands for all opens before it.
"""

from __future__ import annotations

import sys
from collections import OrderedDict

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks get this module with their function; it needn't be installed where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRETCH = (
    "owner BIGINT, stretch INT, first ARRAY<STRING>,"
    " recent ARRAY<STRUCT<file_path: STRING, open_count: BIGINT, last_opened: TIMESTAMP_NTZ, whole: BOOLEAN>>"
)
FOUND = "owner BIGINT, file_path STRING, open_count BIGINT, last_opened TIMESTAMP_NTZ"
ENTRY = ("file_path", "open_count", "last_opened", "whole")


class Stretch:
    def __init__(self, keep: int, first=(), recent=()):
        self.keep = keep
        self.first = dict.fromkeys(first)
        self.recent = OrderedDict((path, [count, last, whole]) for path, count, last, whole in recent)

    def open(self, path: str, last, times: int) -> None:
        held = self.recent.get(path)
        if held:
            held[0] += times
            held[1] = last
            self.recent.move_to_end(path)
            return
        new = len(self.first) < self.keep and path not in self.first
        if new:
            self.first[path] = None
        self.recent[path] = [times, last, new]
        if len(self.recent) > self.keep:
            self.recent.popitem(last=False)

    def join(self, after: Stretch) -> Stretch:
        """This stretch and the one after it, as one."""
        newest = list(reversed(self.recent))
        rank = {path: r for r, path in enumerate(newest)}
        place = {path: k for k, path in enumerate(after.first)}
        first = dict.fromkeys(list(dict.fromkeys([*self.first, *after.first]))[: self.keep])
        begun, recent = list(after.first), []
        for path, (count, last, whole) in after.recent.items():
            if whole and path in rank:
                between = {*newest[: rank[path]], *begun[: place[path]]} - {path}
                whole = len(between) < self.keep
                if whole:
                    before = self.recent[path]
                    count, whole = count + before[0], before[2]
            elif path in self.first or path not in first:
                whole = False
            recent.append((path, count, last, whole))
        older = [(path, *entry) for path, entry in self.recent.items() if path not in after.recent]
        return Stretch(self.keep, first, [*older, *recent][-self.keep :])

    def entries(self) -> list[tuple]:
        return [(path, *entry) for path, entry in self.recent.items()]


def _stretches(keep: int):
    def run(batches):
        owner, stretch, number = None, None, TaskContext.get().partitionId()

        def out():
            recent = [dict(zip(ENTRY, entry)) for entry in stretch.entries()]
            kinds = [pa.string(), pa.int64(), pa.timestamp("us"), pa.bool_()]
            columns = [
                pa.array([owner], pa.int64()), pa.array([number], pa.int32()), pa.array([list(stretch.first)], pa.list_(pa.string())),
                pa.array([recent], pa.list_(pa.struct(list(zip(ENTRY, kinds))))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["owner", "stretch", "first", "recent"])

        for batch in batches:
            for now, path, ts, times in zip(*(column.to_pylist() for column in batch.columns)):
                if stretch is None or now != owner:
                    if stretch:
                        yield out()
                    owner, stretch = now, Stretch(keep)
                stretch.open(path, ts, times)
        if stretch:
            yield out()

    return run


def _joined(keep: int):
    def run(table: pa.Table) -> pa.Table:
        whole = None
        for row in sorted(table.to_pylist(), key=lambda r: r["stretch"]):
            one = Stretch(keep, row["first"], [tuple(r[c] for c in ENTRY) for r in row["recent"]])
            whole = whole.join(one) if whole else one
        rows = [(table["owner"][0].as_py(), *entry[:3]) for entry in whole.entries()]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.timestamp("us")]
        names = ["owner", "file_path", "open_count", "last_opened"]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def recent_files(opens: DataFrame, keep: int, before: DataFrame | None = None) -> DataFrame:
    """``owner, file_path, open_count, last_opened`` of each owner's ``keep`` latest files, as if every open were taken in one by one.

    ``before`` is such a result of all earlier opens; owners without new opens keep theirs. Opens of one file at one instant are
    added up first. Rows without owner, path or time are no opens."""
    sound = opens.where("owner is not null and file_path is not null and ts is not null")
    counted = sound.groupBy("owner", "file_path", "ts").agg(F.count("*").alias("times")).select("owner", "file_path", "ts", "times")
    order = [F.col("owner"), F.col("ts"), F.desc("file_path")]
    stretches = counted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stretches(keep), STRETCH)
    if before is not None:
        entry = F.struct("file_path", "open_count", "last_opened", F.lit(False).alias("whole"))
        by_time = "array_sort(_held, (a, b) -> case when a.last_opened < b.last_opened then -1 when a.last_opened > b.last_opened then 1"
        by_time += " when a.file_path > b.file_path then -1 when a.file_path < b.file_path then 1 else 0 end)"
        held = before.groupBy("owner").agg(F.collect_list(entry).alias("_held"))  # at most ``keep`` an owner
        kept = held.select(
            "owner", F.lit(-1).alias("stretch"), F.lit([]).cast("array<string>").alias("first"), F.expr(by_time).alias("recent")
        )
        stretches = kept.unionByName(stretches)
    return stretches.groupBy("owner").applyInArrow(_joined(keep), FOUND)
