"""A landing folder taken in bit by bit: new files are cleaned and added, each exactly once.

Spark's file source tells which files are new and keeps what was taken in a checkpoint below the target. Each batch of files is read
by the readers of ``tablecare.sources`` (so large files are read range by range), cleaned by the row-wise steps of a plan and
written to folders named by the batch, which are overwritten: a batch that was cut off, by a lost driver say, is done
again as a whole and leaves nothing twice. Every run takes what is there and ends, so it can be called from any scheduler.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.operators.sketches import store_profile
from tablecare.plans.plan import Plan
from tablecare.sources.readers import read_csv, read_json, read_parquet
from tablecare.streaming.clean import clean_stream

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Files of one batch, whose paths pass through the driver.
FILES_PER_BATCH = 1000


@dataclass(frozen=True)
class Landing:
    """Where files come from, how they are read and cleaned, and where their rows go.

    fmt: csv, json (arrays of objects; needs *schema*), jsonl (needs *schema*) or parquet, by extension. All files of a CSV landing share a
    header. profile: also keep a profile of the clean rows (see ``operators.sketches``), one part a batch.
    """

    source: str
    target: str
    plan: Plan
    fmt: str = "csv"
    schema: str | None = None
    profile: bool = False
    files_per_batch: int = FILES_PER_BATCH

    def _read(self, spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
        if self.fmt == "csv":
            return read_csv(spark, paths)
        if self.fmt in ("json", "jsonl"):
            return read_json(spark, paths, lines=self.fmt == "jsonl", schema=self.schema)
        rows = read_parquet(spark, paths)
        return rows, spark.createDataFrame([], "line string")

    def _batch(self, done: Callable[[int], None] | None):
        def take(files: DataFrame, batch: int) -> None:
            spark = files.sparkSession
            paths = sorted(r["path"] for r in files.select("path").collect())
            if not paths:
                return
            rows, rejects = self._read(spark, paths)
            clean = clean_stream(rows, self.plan)
            clean.write.mode("overwrite").parquet(f"{self.target}/rows/batch={batch}")
            rejects.write.mode("overwrite").parquet(f"{self.target}/rejects/batch={batch}")
            if self.profile:
                store_profile(spark.read.parquet(f"{self.target}/rows/batch={batch}"), f"{self.target}/profile", str(batch))
            if done:
                done(batch)

        return take

    def run(self, spark: SparkSession, done: Callable[[int], None] | None = None) -> None:
        """Take in the files that are new, and return. *done* is told each batch that is written, before it is noted as taken."""
        glob = "*.json" if self.fmt in ("json", "jsonl") else f"*.{self.fmt}"
        files = (
            spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", self.files_per_batch).load(self.source)
        )
        # contents are not selected, so they are not read here
        query = (
            files.select("path").writeStream.foreachBatch(self._batch(done)).option("checkpointLocation", f"{self.target}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows taken so far, with the number of their ``batch``; a column that some files lack is null there."""
        return spark.read.option("mergeSchema", True).parquet(f"{self.target}/rows")

    def rejects(self, spark: SparkSession) -> DataFrame:
        """(line, batch) of what could not be read."""
        return spark.read.schema("line string, batch int").parquet(f"{self.target}/rejects")

    def log(self, spark: SparkSession) -> DataFrame:
        """(batch, rows, rejects) of each batch."""
        good = self.rows(spark).groupBy("batch").agg(F.count("*").alias("rows"))
        bad = self.rejects(spark).groupBy("batch").agg(F.count("*").alias("rejects"))
        return good.join(bad, "batch", "full").select("batch", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "rejects")])
