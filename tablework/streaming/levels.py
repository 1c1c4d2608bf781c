"""A keyed table kept as sorted deltas in levels: writing costs what changes, and the newest row of a key wins at reading."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.sources import folders


class Run(NamedTuple):
    """A delta or several merged ones: the numbers of the first and the last, its level, and the tag of the last."""

    first: int
    last: int
    level: int
    tag: str

    @property
    def name(self) -> str:
        return f"run={self.first}-{self.last}-{self.level}-{self.tag}"


class LevelledTable:
    """Runs of rows below ``path``, each with one row per key at most.

    ``add`` writes a batch as a run of level 0. As soon as ``fanout`` runs of one level stand side by side they are merged into one
    of the next level, so a row is written again once a level: about log(batches) times in all, and the table is never
    rewritten for a batch. A merged run takes effect when its folder gets its name and then stands for those it covers, which
    the next ``add`` deletes; readers that are still at them finish. There are fewer than ``fanout`` runs a level.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], fanout: int = 4, fmt: str = "parquet",
                 options: dict[str, str] | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.path, self.keys, self.fanout, self.fmt, self.options = spark, path.rstrip("/"), list(keys), fanout, fmt, options or {}

    def _found(self) -> list[Run]:
        matches = [re.fullmatch(r"run=(\d+)-(\d+)-(\d+)-(\w+)", n) for n in folders.names(self.spark, self.path)]
        return sorted(Run(int(m[1]), int(m[2]), int(m[3]), m[4]) for m in matches if m)

    @staticmethod
    def _valid(found: list[Run]) -> list[Run]:
        return [r for r in found if not any(o != r and o.first <= r.first and r.last <= o.last for o in found)]

    def runs(self) -> list[Run]:
        """The runs that make up the table, oldest first."""
        return self._valid(self._found())

    def _rows(self, run: Run) -> DataFrame:
        return self.spark.read.format(self.fmt).options(**self.options).load(f"{self.path}/{run.name}")

    def _write(self, rows: DataFrame, run: Run) -> None:
        part = f"{self.path}/{run.name}.part"
        rows.sortWithinPartitions(*self.keys).write.format(self.fmt).options(**self.options).mode("overwrite").save(part)
        folders.rename(self.spark, part, f"{self.path}/{run.name}")

    def _newest(self, runs: list[Run]) -> DataFrame:
        rows = None
        for run in runs:
            one = self._rows(run).withColumn("_run", F.lit(run.last))
            rows = one if rows is None else rows.unionByName(one)
        kept = [c for c in rows.columns if c != "_run"]
        if len(runs) == 1:
            return rows.select(*kept)
        row = F.struct(*[F.col(f"`{c}`") for c in kept])
        return rows.groupBy(*self.keys).agg(F.max_by(row, "_run").alias("_row")).select("_row.*")

    def add(self, batch: DataFrame, tag: str) -> None:
        """Put in the changed rows, one per key. A batch of the newest run's ``tag`` is there already and does nothing."""
        found = self._found()
        valid = self._valid(found)
        if not (valid and valid[-1].tag == tag):
            for run in set(found) - set(valid):
                folders.delete(self.spark, f"{self.path}/{run.name}")
            number = valid[-1].last + 1 if valid else 0
            new = Run(number, number, 0, tag)
            self._write(batch, new)
            valid.append(new)
        while len(tail := valid[-self.fanout:]) == self.fanout and len({r.level for r in tail}) == 1:
            merged = Run(tail[0].first, tail[-1].last, tail[0].level + 1, tail[-1].tag)
            self._write(self._newest(tail), merged)
            valid = [*valid[:-self.fanout], merged]

    def read(self) -> DataFrame:
        """The newest row of each key."""
        return self._newest(self.runs())

    def is_empty(self) -> bool:
        return not self.runs()
