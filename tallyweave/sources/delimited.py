"""Dirty compressed CSV to typed rows, as DataFrame steps.

Lines are repaired first (encoding, stray backslashes), then joined to records where a quoted
field spans lines, then parsed and cast. Uncompressed files stay splittable throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructType

from ..functions.numeric import finite, lenient_bigint
from ..session import written
from .schemas import plain

NULL_MARK = r"\N"
_CHUNK = 65536


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, seq, value): physical lines; (chunk, seq) is their order within a file.

    Compression goes by file extension.
    """
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("_start"),
                    F.monotonically_increasing_id().alias("seq"), "value")
            .select("file", F.struct("_start", F.floor(F.col("seq") / _CHUNK).alias("part"))
                    .alias("chunk"), "seq", "value"))


def file_facts(lines: DataFrame, header: list[str]) -> DataFrame:
    """(file, transcode, n_headers): a file with any invalid UTF-8 is Latin-1 throughout;
    ``n_headers`` counts lines equal to the header."""
    return lines.groupBy("file").agg(
        (~F.bool_and(F.is_valid_utf8("value"))).alias("transcode"),
        F.count_if(F.translate("value", '"', "") == ",".join(header)).alias("n_headers"))


def repair_lines(lines: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Decode Latin-1 files and strip backslashes at line ends; adds ``transcoded``.

    ``facts`` tells which files are Latin-1; without it all are.
    """
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if facts is None:
        out = lines.withColumn("transcoded", F.lit(True)).withColumn("value", latin)
    else:
        out = (lines.join(facts.select("file", F.col("transcode").alias("transcoded")), "file")
               .withColumn("value", F.when(F.col("transcoded"), latin)
                           .otherwise(F.col("value"))))
    return out.withColumn("value", F.regexp_replace("value", r"\\$", ""))


def _field_count(text: str) -> Column:
    """Number of fields of a record: commas outside quotes, plus one."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return F.size(F.split(bare, ","))


def quote_events(lines: DataFrame, n_columns: int) -> DataFrame:
    """(file, chunk, seq, kind): lines that may change whether a quoted field is open.

    Quotes come in pairs inside quoted fields, so after taking out the pairs an opening quote
    stands at the start of a field and a closing one at its end. A line is ``O`` if its quotes
    open a field (whatever was before), ``K`` if they close one, ``S`` if they swap the state and
    do not tell which, and ``C`` if it is a complete record whose first quote could not close a
    field. Lines without such quotes leave the state as it is and are no events.

    A written table: it is read several times, and a filter on ``kind`` would otherwise run the
    text matching again for each place that ``kind`` takes the text from.
    """
    bare = F.replace("value", F.lit('""'), F.lit(""))
    odd = F.pmod(F.length("value") - F.length(F.translate("value", '"', "")), F.lit(2)) == 1
    at = ("file", "chunk", "seq")
    quoted = lines.where(F.contains("value", F.lit('"'))).select(*at, "value", bare.alias("bare"),
                                                                 odd.alias("odd"))
    tested = quoted.select(*at, "value", "bare", "odd",
                           F.col("bare").rlike('^([^"]*,)?"').alias("opens"),
                           F.col("bare").rlike('^[^"]*"(,|$)').alias("closes"))
    odd, opens, closes = F.col("odd"), F.col("opens"), F.col("closes")
    kind = (F.when(odd & opens & ~closes, "O").when(odd & closes & ~opens, "K").when(odd, "S")
            .when(F.contains("bare", F.lit('"')) & ~closes & (_field_count("value") == n_columns),
                  "C"))
    return written(tested.select(*at, kind.alias("kind")), "events").where("kind is not null")


def open_spans(lines: DataFrame, events: DataFrame) -> DataFrame:
    """(file, chunk, seq, start): the lines of every record that spans lines, by its first line.

    Two states, open and closed, and every event is a map between them: ``O`` leads to open, ``K``
    and ``C`` to closed, ``S`` swaps. Each chunk composes its events into one map, the maps are
    composed along the file, and with the state before its chunk each event knows its own. A line
    that opens a field begins a record that ends with the next event, if that closes it. If it
    does not (``O``, ``C``, or the end of the file), the quote was never closed, and the line is a
    record by itself. Windows run over events inside a chunk and over one row per chunk.
    """
    inside = Window.partitionBy("file", "chunk").orderBy("seq")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("kind") == "O", 1).when(F.col("kind") != "S", 0)
    ev = (events.withColumn("swaps", F.count_if(F.col("kind") == "S").over(running))
          .withColumn("fixed", F.last((opened + F.col("swaps")) % 2, True).over(running))
          .withColumn("next", F.lead(F.struct("chunk", "seq", "kind")).over(inside)))
    # the map of a chunk: swaps, and the state led to (with all swaps before it taken back)
    maps = events.groupBy("file", "chunk").agg(
        F.min(F.struct("seq", "kind")).alias("first"),
        F.max(F.when(opened.isNotNull(), F.struct("seq", opened.alias("state")))).alias("last"),
        F.count_if(F.col("kind") == "S").alias("all_swaps"))
    after_last = (events.join(maps.select("file", "chunk", F.col("last.seq").alias("_last")),
                              ["file", "chunk"])
                  .where((F.col("kind") == "S") & (F.col("seq") > F.col("_last")))
                  .groupBy("file", "chunk").agg(F.count(F.lit(1)).alias("late_swaps")))
    along = Window.partitionBy("file").orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = (maps.join(after_last, ["file", "chunk"], "left")
            .withColumn("swapped", F.coalesce(F.sum("all_swaps").over(before), F.lit(0)))
            .withColumn("led", F.when(F.col("last").isNotNull(), F.pmod(
                F.col("last.state") + F.coalesce("late_swaps", F.lit(0)) + F.col("swapped")
                + F.col("all_swaps"), F.lit(2))))
            .withColumn("state_in", F.pmod(F.coalesce(F.last("led", True).over(before), F.lit(0))
                                           + F.col("swapped"), F.lit(2)))
            .withColumn("next_chunk", F.lead(F.struct("chunk", "first.seq", "first.kind"))
                        .over(along))
            .select("file", "chunk", "state_in", "next_chunk"))
    ev = (ev.join(ends, ["file", "chunk"])
          .withColumn("state", F.pmod(F.coalesce("fixed", "state_in") + F.col("swaps"), F.lit(2)))
          .withColumn("end", F.coalesce("next", "next_chunk")))
    spans = ev.where((F.col("state") == 1) & F.col("kind").isin("O", "S")
                     & F.col("end.kind").isin("K", "S")).select(
        "file", "chunk", "seq", F.col("end.chunk").alias("last_chunk"),
        F.col("end.seq").alias("last_seq"))
    # a span inside a chunk is a run of its line numbers; others take whole chunks between
    here = F.col("chunk") == F.col("last_chunk")
    start = F.struct("chunk", "seq").alias("start")
    short = spans.where(here).select("file", "chunk", start, F.col("seq").alias("lo"),
                                     F.col("last_seq").alias("hi"))
    sizes = lines.groupBy("file", "chunk").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    numbered = sizes.withColumn("no", F.row_number().over(along))
    long = spans.where(~here)
    for end in ("chunk", "last_chunk"):
        long = long.join(numbered.select("file", F.col("chunk").alias(end),
                                         F.col("no").alias(f"{end}_no")), ["file", end])
    long = (long.select("file", "seq", "last_seq", "chunk_no", "last_chunk_no", start,
                        F.explode(F.sequence("chunk_no", "last_chunk_no")).alias("no"))
            .join(numbered, ["file", "no"])
            .select("file", "chunk", "start",
                    F.when(F.col("no") == F.col("chunk_no"), F.col("seq")).otherwise(F.col("lo"))
                    .alias("lo"),
                    F.when(F.col("no") == F.col("last_chunk_no"), F.col("last_seq"))
                    .otherwise(F.col("hi")).alias("hi")))
    return short.unionByName(long).select(
        "file", "chunk", F.explode(F.sequence("lo", "hi")).alias("seq"), "start")


def logical_records(lines: DataFrame, n_columns: int) -> DataFrame:
    """(file, seq, record, n_lines): lines joined where a quoted field goes on.

    Whether a line lies inside a quoted field follows from the quotes before it alone
    (:func:`open_spans`), so text of a field that looks like a record stays text. Only lines of
    records that span lines are brought together; the others are taken as they are.

    ``lines`` should be cheap to read several times: a written table of repaired lines, since a
    filter on expressions of the text repeats whatever made it. Line numbers of a chunk are
    consecutive.
    """
    spans = written(open_spans(lines, quote_events(lines, n_columns)), "spans")
    single = lines.join(spans, ["file", "chunk", "seq"], "left_anti").select(
        "file", "seq", F.col("value").alias("record"), F.lit(1).alias("n_lines"))
    several = (lines.join(spans, ["file", "chunk", "seq"]).groupBy("file", "start")
               .agg(F.array_sort(F.collect_list(F.struct("chunk", "seq", "value"))).alias("l"))
               .select("file", "start.seq",
                       F.array_join(F.transform("l", lambda x: x["value"]), "\n")
                       .alias("record"), F.size("l").alias("n_lines")))
    return single.unionByName(several)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of a file (one line reaches the driver)."""
    first = spark.read.text(path).limit(1).select(
        F.split(F.regexp_replace("value", '"', ""), ",").alias("h")).first()
    return [] if first is None else list(first["h"])


def file_headers(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of every file, split; empty files have no row."""
    first = lines.groupBy("file").agg(F.min(F.struct("chunk", "seq")).alias("at")).select(
        "file", "at.chunk", "at.seq")
    return lines.join(first, ["file", "chunk", "seq"]).select(
        "file", F.split(F.regexp_replace("value", '"', ""), ",").alias("header"))


def parse_records(records: DataFrame, header: list[str]) -> DataFrame:
    """Split records into text columns named after ``header``; keeps file, seq, n_lines.

    Adds ``n_fields`` and ``open_quote`` (a quote was never closed). A quote inside a quoted field is written twice; the backslash is an
    ordinary character. Header lines are dropped.
    """
    names = [plain(h) for h in header]
    ddl = ", ".join(f"`{n}` string" for n in names)
    parsed = records.where(F.translate("record", '"', "") != ",".join(header)).select(
        "file", "seq", "n_lines", _field_count("record").alias("n_fields"),
        (F.pmod(F.length("record") - F.length(F.translate("record", '"', "")), F.lit(2)) == 1)
        .alias("open_quote"),
        F.from_csv("record", ddl, {"escape": '"', "quote": '"', "mode": "PERMISSIVE",
                                   "maxCharsPerColumn": "-1"}).alias("r"))
    cols = []
    for i, n in enumerate(names):
        # An empty field reads as NULL; a field the record does not have is NULL.
        text = F.coalesce(F.col("r")[n], F.lit(""))
        cols.append(F.when(F.col("n_fields") > i, text).alias(n))
    return parsed.select("file", "seq", "n_lines", "n_fields", "open_quote", *cols)


def typed(name: str, kind, empty_is_null: bool) -> Column:
    """Cast a text column; a value that does not fit becomes NULL, and so does the null mark."""
    raw = F.when(F.col(name) != NULL_MARK, F.col(name))
    if isinstance(kind, LongType):
        return lenient_bigint(F.trim(raw)).alias(name)
    if isinstance(kind, DoubleType):
        return finite(raw.try_cast("double")).alias(name)
    if isinstance(kind, DateType):
        return raw.try_cast("date").alias(name)
    return (F.nullif(raw, F.lit("")) if empty_is_null else raw).alias(name)


def typed_projection(parsed: DataFrame, schema: StructType, extra: tuple[str, ...] = (),
                     empty_is_null: bool = False) -> DataFrame:
    return parsed.select(*extra, *[typed(f.name, f.dataType, empty_is_null) for f in schema])


def cycle_of_file(file: Column, pattern: str = r".*_(\d{4})(?![0-9])") -> Column:
    """Cycle named in a path (the last one); NULL when there is none."""
    return F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).cast("bigint")
