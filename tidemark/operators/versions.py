"""Tables in whole versions, and the high-water view of a store that is brought up to date by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import METRICS, merged_high_water


class Versions:
    """A table of which every version lies in a folder of its own; the newest complete one is current.

    A version counts once the marker that Spark writes last is there, so readers never see half
    of one, and a write that broke off is written over.  One writer at a time.
    """

    MARKER = "_SUCCESS"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, number: int) -> str:
        return f"{self.folder}/v={number}"

    def numbers(self) -> list[int]:
        """Complete versions, oldest first."""
        _, fs = self._fs()
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/{self.MARKER}"))
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found or [])

    def current(self) -> int | None:
        return max(self.numbers(), default=None)

    def write(self, rows: DataFrame) -> int:
        """The next version; rows may be read from the current one."""
        number = (self.current() or 0) + 1
        rows.write.mode("overwrite").parquet(self.path(number))
        return number

    def read(self, number: int | None = None) -> DataFrame | None:
        number = number or self.current()
        return None if number is None else self.spark.read.parquet(self.path(number))

    def keep(self, last: int) -> None:
        """Delete all but the newest versions; those that a reader may still be at should stay."""
        _, fs = self._fs()
        for n in self.numbers()[:-last]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(n)), True)


class MaintainedMarks:
    """The high-water marks of a store as a table, kept up to date from the attempts completed since.

    A version of the view has its marks, and in ``merged`` the attempts that are in them; both
    are written before the version counts: the list of attempts names the version of the marks
    and is written last, it is the pointer.  A refresh reads the view and the new attempts' own
    folders, never the snapshots that are merged already.
    """

    #: Attempts merged at a time; their names, not their rows, pass the driver.
    MOST_ATTEMPTS = 10_000
    #: Versions of marks and lists that stay for readers that have begun with them.
    KEPT = 3

    def __init__(self, store, table: str = "snapshots"):
        self.store, self.spark, self.table = store, store.spark, table
        self.marks = Versions(store.spark, f"{store.folder}/_high_water/marks")
        self.merged = Versions(store.spark, f"{store.folder}/_high_water/merged")

    def _list(self) -> DataFrame | None:
        return self.merged.read()

    def pending(self) -> list[tuple[int, str]]:
        """Completed attempts that aren't in the view, at most MOST_ATTEMPTS of them."""
        done, seen = self.store.completed(), self._list()
        if seen is not None:
            done = done.join(seen.select("run_id", "attempt"), ["run_id", "attempt"], "left_anti")
        return [tuple(r) for r in done.select("run_id", "attempt").limit(self.MOST_ATTEMPTS).collect()]

    def changes(self, attempts: list[tuple[int, str]]) -> DataFrame | None:
        """The rows that those attempts published, from their own folders; None if they published none."""
        paths = [f"{self.store.folder}/{self.table}/run_id={run}/attempt={attempt}" for run, attempt in attempts]
        paths = [p for p in paths if self.store._exists(p.removeprefix(f"{self.store.folder}/"))]
        return self.spark.read.option("basePath", f"{self.store.folder}/{self.table}").parquet(*paths) if paths else None

    def refresh(self) -> int:
        """Merge all that has been completed since; the number of attempts that were new."""
        total = 0
        while attempts := self.pending():
            rows, old, seen = self.changes(attempts), self.read(), self._list()
            if rows is not None:
                new = rows.select("post_id", *METRICS)
                number = self.marks.write(merged_high_water(old, new) if old is not None else merged_high_water(_no_marks(self.spark), new))
            else:
                number = None if seen is None else seen.agg(F.max("marks")).first()[0]
            names = self.spark.createDataFrame(attempts, "run_id long, attempt string")
            every = names if seen is None else seen.select("run_id", "attempt").unionByName(names)
            self.merged.write(every.withColumn("marks", F.lit(number).cast("int")))
            self.marks.keep(self.KEPT), self.merged.keep(self.KEPT)
            total += len(attempts)
        return total

    def read(self) -> DataFrame | None:
        """post_id and the marks as of the last refresh that was finished; None before the first one."""
        seen = self._list()
        number = None if seen is None else seen.agg(F.max("marks")).first()[0]
        return None if number is None else self.marks.read(number)


def _no_marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "post_id long, " + ", ".join(f"max_{m} long" for m in METRICS))
