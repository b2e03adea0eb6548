"""Continuous variants: new-file ingest and running scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import CONTRIBUTION_TYPES, cycle_sums, scores_of_sums
from ..session import scratch_path
from ..sources.datasets import convert_files, last_runs
from ..sources.schemas import CONTRIBUTIONS

#: Parts of the table of current scores; a batch rewrites those that hold one of its donors.
BUCKETS = 64


def stream_contributions(spark: SparkSession, pattern: str, root: str, ledger_path: str,
                         checkpoint: str, schema: StructType = CONTRIBUTIONS,
                         files_per_batch: int = 100) -> StreamingQuery:
    """Convert files as they arrive, then stop (availableNow).

    The stream carries file names; each batch takes whole files through the same steps as
    ``ingest_contributions``: encoding, backslashes, records that span lines, own headers, checks
    against the cycle in the file's name, a part of the table per file. The ledger is the commit:
    a batch that runs again leaves out what it lists as converted, and a file written without
    being listed is replaced by itself.
    """
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary")
             .option("maxFilesPerTrigger", files_per_batch).load(pattern)
             .select(F.col("path").alias("file"), F.col("length").alias("bytes"),
                     F.col("modificationTime").alias("modified")))

    def convert(batch: DataFrame, number: int) -> None:
        todo, known = batch, last_runs(batch.sparkSession, ledger_path)
        if known is not None:
            done = known.where("status = 'converted'").select("file", "bytes", "modified")
            todo = todo.join(done, ["file", "bytes", "modified"], "left_anti")
        convert_files(batch.sparkSession, todo, root, ledger_path, schema)

    return (files.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def running_scores(donations: DataFrame, types: Sequence[str] = CONTRIBUTION_TYPES,
                   donor: str = "donor_id", cycle: str = "cycle", **cols: str) -> DataFrame:
    """Streaming twin of ``dynamic_score``: sums per donor and cycle, updated with each batch.

    State is one row per donor and own cycle, with the exact parts of the weighted sum
    (``_s_0..``). As in ``dynamic_score``, what is carried into the next cycle is such a row, not
    each donation: ``latest_scores`` does that. Cycles close by calendar, so there is no watermark.
    """
    return cycle_sums(donations, types, donor, cycle, **cols).drop("_rows")


def write_updates(totals: DataFrame, out: str, checkpoint: str, donor: str = "donor_id",
                  cycle: str = "cycle", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the table of current totals at ``out``, one row per donor and cycle.

    A batch brings the new totals of the keys it changed. They replace the old ones in the parts
    of the table, by hash of the donor, that hold one of them; other parts are not read. Totals
    are no increments, so a batch that runs again after a failure gives the same table.
    """
    bucket = F.pmod(F.xxhash64(donor), F.lit(buckets)).cast("int")
    spark = totals.sparkSession  # a batch's own session plans without adaptive execution

    def save(batch: DataFrame, number: int) -> None:
        changed, path = batch.withColumn("bucket", bucket), scratch_path(spark, "batch")
        changed.write.parquet(path)
        new = spark.read.schema(changed.schema).parquet(path)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # <= buckets
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(out).where(F.col("bucket").isin(touched))
            merged = new.unionByName(old.join(new.select(donor, cycle), [donor, cycle], "left_anti"))
        except AnalysisException:  # nothing there yet
            merged = new
        # The old parts are read until the job is committed: new files are staged, then swapped in.
        (merged.hint("rebalance", "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out))

    return (totals.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_scores(spark: SparkSession, out: str, donor: str = "donor_id", cycle: str = "cycle",
                  step: int = 2) -> DataFrame:
    """Current score per donor and cycle, over the cycle itself and the one before."""
    return scores_of_sums(spark.read.parquet(out), donor, cycle, step)
