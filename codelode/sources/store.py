"""Tables that outlive a job: parquet directories, partitioned by what is replaced or dropped at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """A table of parquet files under one directory; ``part`` is its partition column (a repository, a job, a run)."""

    spark: SparkSession
    directory: str
    part: str

    def exists(self) -> bool:
        """SNK2, SNK11: whether anything has been written yet."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.directory)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def ensure(self, rows: DataFrame) -> None:
        """SNK2, SNK11: makes the table, empty, with the columns of ``rows``; one that is there stays."""
        if not self.exists():
            rows.limit(0).write.partitionBy(self.part).parquet(self.directory)
            # no partition, no file: the schema needs one
            if not any(True for _ in self._files()):
                rows.limit(0).coalesce(1).write.mode("append").parquet(f"{self.directory}/{self.part}=__HIVE_DEFAULT_PARTITION__")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.directory)
        return [f for f in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory()]

    def read(self, value: str | None = None) -> DataFrame:
        """SRC11-13, SRC18: all rows, or those of one partition (only its files are read)."""
        rows = self.spark.read.parquet(self.directory)
        return rows if value is None else rows.where(F.col(self.part) == value)

    def replace(self, rows: DataFrame) -> None:
        """SNK1, SNK16: writes the partitions that rows has, each in place of what it held; others stay.

        Rows may come from this very table: they are written beside it first, so a failed job leaves it whole.
        """
        from codelode.session import cut

        cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.directory)

    def append(self, rows: DataFrame) -> None:
        """SNK12-14: adds rows; an empty frame adds nothing."""
        rows.write.mode("append").partitionBy(self.part).parquet(self.directory)

    def drop(self, value: str) -> None:
        """SNK4, SNK9-10: removes one partition's files; one that isn't there is no error."""
        self._delete(f"{self.directory}/{self.part}={value}")

    def drop_all(self) -> None:
        """SNK5: removes the table."""
        self._delete(self.directory)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """SNK6: the keys that come more than once, with how often; empty where the key is unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def deliver(send: Callable[[list[dict]], None], failed: Store | None = None, tries: int = 3, at_once: int = 1000, pause: float = 1.0) -> Callable[[DataFrame, int], None]:
    """SNK15: a foreachBatch sink that hands rows to ``send`` where they are, ``at_once`` at a time, with retries.

    A delivery that fails every time doesn't fail the stream: its rows are written to ``failed``, a table
    with the rows' columns and the batch's number as its part. ``send`` must bear repeats.
    """

    def partition(batches):
        import itertools
        import time

        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                some = whole.slice(at, at_once)
                for attempt in itertools.count(1):
                    try:
                        send(some.to_pylist())
                        break
                    except Exception:
                        if attempt >= tries:
                            yield pa.RecordBatch.from_arrays(some.columns, schema=some.schema)
                            break
                        time.sleep(pause * 2 ** (attempt - 1))

    def run(batch: DataFrame, number: int) -> None:
        left = batch.mapInArrow(partition, batch.schema)
        if failed is None:
            left.write.format("noop").mode("overwrite").save()
        else:
            failed.append(left.withColumn(failed.part, F.lit(number)))

    return run


def summary(scores: DataFrame) -> DataFrame:
    """SNK17: scores as percent texts for printing."""
    from codelode.functions.text import percent

    return scores.select("agent", "tp", "fp", "fn", *(percent(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))
