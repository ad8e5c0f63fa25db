"""State per key that streams keep in files: one small table per batch, merged level by level.

A batch adds a *run*, the folded rows of the keys it touched. When as many runs of one level lie behind one
another as ``fan`` says, they become one run of the next level, so that after n batches there are O(log n) of them to
read, whatever happened before. A run is named after its first and last batch and counts from the moment its
commit marker is there; it then stands for all runs inside its range. So the switch to a merged run is one file
that appears, a crash before it leaves the old runs in force, and a batch that is repeated finds itself done.

Nothing is kept in executors or in the engine's state store. Keys that are finished can be retired: their rows go
to an archive that is not merged again, and they come back into view only where late events reach them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile(r"^run-(\d+)-(\d+)$")
_RETIRED = re.compile(r"^retired-(\d+)-(\d+)$")


@dataclass(frozen=True)
class Fold:
    """How rows become state: ``partial`` of events, ``merge`` of partial rows in any order and grouping, and
    ``final`` of merged ones. ``finished`` gives a Column that tells of a merged row that nothing more is expected."""

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    final: Callable[[DataFrame], DataFrame]
    finished: Callable[[], Column] | None = None


class RunStore:
    """The runs under one folder. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, fold: Fold, fan: int = 8):
        self.spark, self.folder, self.fold, self.fan = spark, folder.rstrip("/"), fold, fan
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, pattern: re.Pattern) -> list[tuple[int, int]]:
        """Ranges of the committed tables of a kind; the folder holds O(log n) of them and what waits to be deleted."""
        if not self._files.exists(self._path(self.folder)):
            return []
        found = [pattern.match(s.getPath().getName()) for s in self._files.listStatus(self._path(self.folder))]
        return sorted(
            (int(m[1]), int(m[2])) for m in found
            if m and self._files.exists(self._path(f"{self.folder}/{m[0]}/_SUCCESS"))
        )

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of the runs in force, in order."""
        every = self._names(_RUN)
        return [r for r in every if not any(_holds(o, r) for o in every)]

    def retired(self) -> list[tuple[int, int]]:
        """Archives whose range a run in force covers: the run without the retired keys was committed."""
        runs = self.runs()
        return [r for r in self._names(_RETIRED) if any(_holds(o, r) or o == r for o in runs)]

    def _read(self, kind: str, ranges: list[tuple[int, int]]) -> DataFrame | None:
        paths = [f"{self.folder}/{kind}-{a}-{b}" for a, b in ranges]
        return self.spark.read.parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, kind: str, first: int, last: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}-{first}-{last}")

    def add(self, events: DataFrame, batch: int) -> None:
        """Take a batch in; one that is in already is left out."""
        if not any(a <= batch <= b for a, b in self.runs()):
            self._write(self.fold.partial(events), "run", batch, batch)
        self.compact()

    def compact(self) -> None:
        """Merge while the last ``fan`` runs are of one level, and delete what earlier merges replaced."""
        while True:
            runs = self.runs()
            tail = runs[-self.fan :]
            if len(tail) < self.fan or len({self._level(r) for r in tail}) > 1:
                return
            self.clean()
            self._write(self.fold.merge(self._read("run", tail)), "run", tail[0][0], tail[-1][1])

    def _level(self, run: tuple[int, int]) -> int:
        size, level = run[1] - run[0] + 1, 0
        while size >= self.fan:
            size, level = size // self.fan, level + 1
        return level

    def clean(self) -> None:
        """Delete runs that others stand for, and archives that no commit followed.

        A merge leaves what it replaced until the next one, for readers that are still at it.
        """
        runs, retired = set(self.runs()), set(self.retired())
        for kind, pattern, kept in (("run", _RUN, runs), ("retired", _RETIRED, retired)):
            for a, b in self._names(pattern):
                if (a, b) not in kept:
                    self._files.delete(self._path(f"{self.folder}/{kind}-{a}-{b}"), True)

    def retire(self) -> None:
        """Move the finished keys to an archive and merge what is left into one run."""
        runs = self.runs()
        if not runs or self.fold.finished is None:
            return
        self.clean()
        first, last = runs[0][0], runs[-1][1]
        if runs == [(first, last)]:
            return  # its range is in force; the next batch gives a new one
        merged, finished = self.fold.merge(self._read("run", runs)), F.coalesce(self.fold.finished(), F.lit(False))
        self._write(merged.filter(finished), "retired", first, last)
        # From this commit on both tables count; before it neither does.
        self._write(merged.filter(~finished), "run", first, last)

    def current(self) -> DataFrame | None:
        """The state of all keys, retired ones included; None before the first batch."""
        parts = [p for p in (self._read("run", self.runs()), self._read("retired", self.retired())) if p is not None]
        return self.fold.final(self.fold.merge(reduce(DataFrame.unionByName, parts))) if parts else None


def _holds(outer: tuple[int, int], inner: tuple[int, int]) -> bool:
    return outer != inner and outer[0] <= inner[0] and inner[1] <= outer[1]
