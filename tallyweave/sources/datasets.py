"""Tables at rest: partitioned Parquet, registers, crosswalk files, the ingest ledger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.quality import CheckFailed, schema_problems
from ..session import written
from .delimited import (cycle_of_file, file_facts, file_headers, logical_records, parse_records,
                        read_header, read_lines, repair_lines, typed_projection)
from .schemas import (CONTRIBUTIONS, CONTRIBUTORS, FIRST_CYCLE, LAST_CYCLE, REGISTER_JSON)

LEDGER = ("file string, cycle bigint, n_lines bigint, transcoded boolean, n_written bigint, "
          "n_bad bigint, n_torn bigint, n_open_quote bigint, n_wrong_cycle bigint, status string, "
          "bytes bigint, modified timestamp, at timestamp")


def write_by_cycle(df: DataFrame, root: str, records_per_file: int = 5_000_000,
                   parts: tuple[str, ...] = ("cycle",)) -> None:
    """Hive layout by cycle (and further columns); only the partitions present are replaced.

    The rebalance hint lets AQE cut a cycle that holds most rows into several files and merge
    small pieces. A table that is there already must have the same columns and types.
    """
    check_same_schema(df, root, parts)
    (df.hint("rebalance", *parts).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .option("maxRecordsPerFile", records_per_file).partitionBy(*parts).parquet(root))


def check_same_schema(df: DataFrame, root: str, parts: tuple[str, ...] = ()) -> None:
    """Stop before a table is mixed from parts with different columns or types. Partition columns
    ``parts`` have no type of their own."""
    try:
        there = df.sparkSession.read.parquet(root).drop(*parts).schema
    except AnalysisException:
        return
    mine = df.drop(*parts).schema
    problems = schema_problems(there, mine) + [
        f"other column {f.name}" for f in there if f.name not in mine.names]
    if problems:
        raise CheckFailed(f"table at {root}: {'; '.join(problems)}")


def read_by_cycle(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Partitioned table with ``cycle`` pinned to bigint (``schema`` names it); partition columns
    that ``schema`` does not name stay out."""
    return spark.read.schema(schema).parquet(root).select(*schema.names)


def write_table(df: DataFrame, path: str, records_per_file: int | None = None,
                block_bytes: int | None = None) -> None:
    w = df.write.mode("overwrite")
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    if block_bytes:
        w = w.option("parquet.block.size", block_bytes)
    w.parquet(path)


def read_parts(spark: SparkSession, root: str, pattern: str = "part[-_]*.parquet") -> DataFrame:
    """Parquet part files of a folder; anything else lying there is ignored."""
    return spark.read.option("pathGlobFilter", pattern).parquet(root)


def read_register_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Company register from JSON objects (one per file, or one per line): broken ones are
    skipped, empty codes are NULL."""
    raw = (spark.read.schema(REGISTER_JSON).option("multiLine", one_per_file)
           .option("mode", "DROPMALFORMED").json(path))
    return raw.where(F.col("name").isNotNull()).select(
        F.col("cik").try_cast("int").alias("cik"), F.col("name").alias("real_name"),
        F.nullif("sic", F.lit("")).alias("sic"),
        F.nullif("sicDescription", F.lit("")).alias("sic_description"))


def write_crosswalk(crosswalk: DataFrame, root: str) -> None:
    small = crosswalk.coalesce(1)       # at most one row per four-digit code
    small.write.mode("overwrite").option("header", True).csv(f"{root}/csv")
    small.write.mode("overwrite").parquet(f"{root}/parquet")


def read_crosswalk_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """With an explicit schema, so that codes keep their leading zeros."""
    return spark.read.schema(schema).option("header", True).csv(path)


def _table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def source_name(file: Column) -> Column:
    """Name of a source file's part of the table: its base name and a hash of its path."""
    return F.concat(F.substring_index(file, "/", -1), F.lit("-"), F.hex(F.xxhash64(file)))


def last_runs(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """The latest ledger row of every file."""
    ledger = _table_or_none(spark, ledger_path, LEDGER)
    if ledger is None:
        return None
    return (ledger.groupBy("file").agg(F.max_by(F.struct("*"), "at").alias("r")).select("r.*"))


def new_files(spark: SparkSession, pattern: str, ledger_path: str, root: str | None = None,
              force: bool = False) -> DataFrame:
    """(file, bytes, modified) of the files to convert: those that are new, changed since, failed
    before, or whose part of the table at ``root`` is gone; with ``force`` all."""
    files = (spark.read.format("binaryFile").load(pattern)
             .select(F.col("path").alias("file"), F.col("length").alias("bytes"),
                     F.col("modificationTime").alias("modified")))
    ledger = last_runs(spark, ledger_path)
    if ledger is None or force:
        return files
    done = ledger.where("status = 'converted'")
    if root is not None:
        there = _table_or_none(spark, root, "cycle bigint, source string")
        if there is None:
            return files
        there = there.select("cycle", "source").distinct()
        done = done.withColumn("source", source_name(F.col("file"))).join(
            there, ["cycle", "source"], "left_semi")
    return files.join(done.select("file", "bytes", "modified"), ["file", "bytes", "modified"],
                      "left_anti")


def read_contributions(spark: SparkSession, paths: list[str] | str,
                       schema: StructType = CONTRIBUTIONS) -> tuple[DataFrame, DataFrame]:
    """Typed rows with bookkeeping columns, and facts per file (see ``file_facts``), of files that
    share a header.

    Bookkeeping: file, file_cycle, row_cycle, n_lines, and the flags bad, torn, open_quote.
    """
    lines = written(read_lines(spark, paths), "lines")
    headers = file_headers(lines).select("header").distinct().collect()
    if len(headers) != 1:
        raise ValueError(f"{paths}: {len(headers)} different headers")
    header = headers[0]["header"]
    missing = [f.metadata["source_name"] for f in schema
               if f.metadata["source_name"] not in header]
    if missing or "cycle" not in header:
        raise ValueError(f"columns missing in {paths}: {missing or ['cycle']}")
    return _typed_rows(lines, header, schema)


def _typed_rows(lines: DataFrame, header: list[str],
                schema: StructType) -> tuple[DataFrame, DataFrame]:
    """See :func:`read_contributions`; ``lines`` are staged as they came."""
    facts = written(file_facts(lines, header), "files")
    records = logical_records(written(repair_lines(lines, facts), "repaired"), len(header))
    parsed = parse_records(records, header)
    marked = (parsed.withColumn("file_cycle", cycle_of_file(F.col("file")))
              .withColumn("row_cycle", F.col("cycle").try_cast("double").try_cast("bigint"))
              .withColumn("bad", F.col("n_fields") > len(header))
              .withColumn("torn", F.col("row_cycle").isNull()))
    return typed_projection(marked, schema, ("file", "file_cycle", "row_cycle", "n_lines", "bad",
                                             "torn", "open_quote")), facts


def ledger_rows(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """One ledger row per file; a file fails if a row has another cycle than its name says, if
    that is no known cycle, or if no row is left."""
    good = ~F.col("bad") & ~F.col("torn")
    per = rows.groupBy("file").agg(
        F.max("file_cycle").alias("cycle"), F.sum("n_lines").cast("bigint").alias("n_lines"),
        F.count_if(good).alias("n_written"), F.count_if("bad").alias("n_bad"),
        F.count_if("torn").alias("n_torn"), F.count_if("open_quote").alias("n_open_quote"),
        F.count_if(good & ~F.col("row_cycle").eqNullSafe(F.col("file_cycle")))
        .alias("n_wrong_cycle"))
    fine = ((F.col("n_wrong_cycle") == 0) & (F.col("n_written") > 0)
            & F.coalesce(F.col("cycle").between(FIRST_CYCLE, LAST_CYCLE), F.lit(False)))
    return per.join(facts, "file").select(
        "file", "cycle", "n_lines", F.col("transcode").alias("transcoded"), "n_written", "n_bad",
        "n_torn", "n_open_quote", "n_wrong_cycle",
        F.when(fine, "converted").otherwise("failed").alias("status"))


def ingest_contributions(spark: SparkSession, pattern: str, root: str, ledger_path: str,
                         schema: StructType = CONTRIBUTIONS, force: bool = False) -> DataFrame:
    """Convert new and changed files to the table at ``root``; returns the ledger's latest row per
    file.

    Each file is parsed by its own header and has a part of the table for itself, below its cycle:
    a later file of a cycle adds rows, the same file again replaces its own. Rows are staged and
    checked before anything is published; files that fail a check are marked ``failed`` in the
    ledger, the others are published. Compressed text is read once, to stage its lines; headers
    of all files come from one job, and only the distinct ones reach the driver.
    """
    convert_files(spark, new_files(spark, pattern, ledger_path, root, force), root, ledger_path,
                  schema)
    return last_runs(spark, ledger_path)


def convert_files(spark: SparkSession, files: DataFrame, root: str, ledger_path: str,
                  schema: StructType = CONTRIBUTIONS) -> None:
    """Convert ``files`` (file, bytes, modified) and add their rows to the ledger; see
    :func:`ingest_contributions`."""
    todo = written(files, "todo")
    names = [r["file"] for r in todo.select("file").collect()]  # file names, not rows
    if names:
        needed = {f.metadata["source_name"] for f in schema} | {"cycle"}
        lines = written(read_lines(spark, names), "lines")
        headers = written(file_headers(lines), "headers")
        rows = ledger = None
        for header, in headers.select("header").distinct().collect():
            if not needed <= set(header):
                continue
            of_header = headers.where(F.col("header") == F.array(*map(F.lit, header)))
            part, facts = _typed_rows(lines.join(of_header.select("file"), "file", "left_semi"),
                                      header, schema)
            part = written(part, "staged")
            entries = ledger_rows(part, facts)
            rows = part if rows is None else rows.unionByName(part)
            ledger = entries if ledger is None else ledger.unionByName(entries)
        known = todo.withColumn("at", F.current_timestamp())
        if ledger is None:
            entries = known.select("file", F.lit("failed").alias("status"), "bytes", "modified", "at")
        else:
            entries = known.join(ledger, "file", "left").withColumn(
                "status", F.coalesce("status", F.lit("failed")))
        kinds = spark.createDataFrame([], LEDGER).schema
        entries = written(entries.select(*[
            (F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType)
            .alias(f.name) for f in kinds]), "ledger")
        if rows is not None:
            fine = entries.where("status = 'converted'").select(
                "file", source_name(F.col("file")).alias("source")).distinct()
            good = (rows.where(~F.col("bad") & ~F.col("torn")).join(fine, "file")
                    .select(*schema.names, F.col("file_cycle").alias("cycle"), "source"))
            write_by_cycle(good, root, parts=("cycle", "source"))
        entries.write.mode("append").parquet(ledger_path)


def read_contributors(spark: SparkSession, path: str,
                      schema: StructType = CONTRIBUTORS) -> DataFrame:
    """Typed contributor rows; the source is always Latin-1, null mark and empty are both NULL."""
    header = read_header(spark, path)
    lines = written(repair_lines(read_lines(spark, path)), "lines")
    records = logical_records(lines, len(header))
    parsed = parse_records(records, header).where(F.col("n_fields") <= len(header))
    return typed_projection(parsed, schema, empty_is_null=True)


def table_is_complete(spark: SparkSession, root: str, schema: StructType) -> bool:
    """Is there a readable, non-empty table at ``root`` with all columns of ``schema``?"""
    try:
        found = spark.read.parquet(root)
    except AnalysisException:
        return False
    problems = [p for p in schema_problems(found.schema, schema) if p.startswith("missing")]
    return not problems and not found.isEmpty()
