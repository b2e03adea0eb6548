"""The given tables in the roles of donations, donors, a company register and industry codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import cycle_of_year
from ..operators.crosswalk import build_crosswalk, clean_code_list, code_universe

TYPES = ("A", "N")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as donations: who gave (order customer), to whom (supplier), when, how much."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    s = table(spark, sf_dir, "supplier")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("donor_id"),
                    F.col("l_suppkey").alias("recipient_id"), F.col("l_partkey").alias("part_id"),
                    cycle_of_year(F.year("o_orderdate")).alias("cycle"),
                    (F.col("l_extendedprice") / 10 - 500).alias("amount"),
                    F.col("l_returnflag").alias("transaction_type"),
                    (F.col("s_acctbal") / 5000 - 1).alias("candidate_score"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("priority")))


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("donor_id"),
                    F.nullif("c_nationkey", F.lit(7)).alias("city"),
                    F.col("c_mktsegment").alias("segment"),
                    F.concat_ws("-", F.col("c_nationkey").cast("string"),
                                F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("zip"),
                    (F.col("c_acctbal") / 5000 - 1).alias("static_score"))


def part_code(size: str = "p_size", brand: str = "p_brand") -> Column:
    """Industry code of a part, 111..625."""
    return (F.lit(100) + F.col(size) * 10
            + F.regexp_extract(brand, r"(\d+)", 1).cast("int")).cast("int")


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with a clean company name and the text an employer field might hold.

    The text is NULL, exact up to case and legal form, or carries one or two typing errors, or is
    spelled backwards, depending on the part key.
    """
    p = table(spark, sf_dir, "part")
    base = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    v = F.pmod(F.col("p_partkey"), F.lit(8))
    b = F.col("real_name")
    k = (F.pmod(F.floor(F.col("p_partkey") / 8), F.lit(9)) + 2).cast("int")

    def head(n: Column) -> Column:
        return b.substr(F.lit(1), n)

    def tail(n: Column) -> Column:
        return b.substr(n, F.lit(100))

    text = (F.when(v == 0, F.lit(None).cast("string"))
            .when(v == 1, F.concat(b, F.lit(", Inc.")))
            .when(v == 2, F.upper(b))
            .when(v == 3, F.concat(head(k), tail(k + 2)))
            .when(v == 4, F.concat(head(k), F.lit("x"), tail(k + 1)))
            .when(v == 5, F.concat(head(k - 1), b.substr(k + 1, F.lit(1)),
                                   b.substr(k, F.lit(1)), tail(k + 2)))
            .when(v == 6, F.reverse(b))
            .otherwise(F.concat(head(k), F.lit("q"), b.substr(k + 2, F.lit(4)), tail(k + 7),
                                F.lit(" Co."))))
    return (p.select("p_partkey", "p_size", "p_brand", "p_type", "p_name",
                     base.alias("real_name"))
            .withColumn("employer", text)
            .withColumn("code", part_code()))


def register_rows(companies: DataFrame) -> DataFrame:
    """Raw register: one row per part, no code for the largest size."""
    return companies.select(
        F.col("p_partkey").alias("cik"), "real_name",
        F.when(F.col("p_size") != 50, F.lpad(F.col("code").cast("string"), 4, "0")).alias("sic"),
        F.col("p_type").alias("sic_description"))


def industry_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition rows of three schemes, spelled out from the parts' brands and sizes."""
    cells = table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b"),
        F.col("p_size").alias("z")).distinct()
    columns = ("scheme", "ff_num", "ff_abbr", "ff_name", "sic_from", "sic_to", "range_desc")
    rows = cells.selectExpr("""stack(3,
        12, b % 11 + 1, concat('G', b % 11 + 1), concat('Group ', b % 11 + 1), 100 + z * 150,
        120 + z * 150 + b, cast(null as string),
        48, b, concat('I', b), if(b % 2 = 0, concat('Industry ', b), concat('I', b)),
        100 + z * 190, 100 + z * 190 + b * 7, concat('size ', z),
        49, b, case b when 17 then 'Softw' when 3 then 'Hardw' when 8 then 'Chips'
            else concat('B', b) end, concat('Brand ', b), 100 + z * 10 + b,
        100 + z * 10 + b + z % 7, concat('size ', z))""").toDF(*columns)
    other = spark.createDataFrame(
        [(12, 12, "Other", "Everything else", None, None, None),
         (48, 48, "Other", "Other", None, None, None),
         (49, 49, "Other", "Almost nothing", None, None, None)], rows.schema)
    return rows.unionByName(other)


def industry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same definitions as lines of text files: (scheme, line_no, line).

    At most a few thousand lines per scheme (brands times sizes).
    """
    d = industry_definitions(spark, sf_dir)
    heads = d.select("scheme", "ff_num", F.lit(0).alias("kind"), F.lit(0).alias("a"),
                     F.lit(0).alias("z"), F.concat(
        F.lpad(F.col("ff_num").cast("string"), 2, " "), F.lit(" "), F.col("ff_abbr"),
        F.when(F.col("ff_name") != F.col("ff_abbr"), F.concat(F.lit("  "), F.col("ff_name")))
        .otherwise(F.lit(""))).alias("line")).distinct()
    ranges = d.where(F.col("sic_from").isNotNull()).select(
        "scheme", "ff_num", F.lit(1).alias("kind"), F.col("sic_from").alias("a"),
        F.col("sic_to").alias("z"), F.concat(
            F.lit("          "), F.lpad(F.col("sic_from").cast("string"), 4, "0"), F.lit("-"),
            F.lpad(F.col("sic_to").cast("string"), 4, "0"),
            F.coalesce(F.concat(F.lit(" "), F.col("range_desc")), F.lit(""))).alias("line"))
    w = Window.partitionBy("scheme").orderBy("ff_num", "kind", "a", "z", "line")
    return heads.unionByName(ranges).select(
        "scheme", (F.row_number().over(w) * 2).alias("line_no"), "line")


def listed_codes(companies: DataFrame) -> DataFrame:
    """Code list as scraped text: code with letters, untrimmed office and title."""
    return companies.select(F.concat(F.lit("Code "), F.col("code").cast("string")).alias("sic"),
                            F.concat(F.lit("  "), F.col("p_type")).alias("office"),
                            F.concat(F.col("p_name"), F.lit(" ")).alias("title"))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_crosswalk(code_universe(spark),
                           clean_code_list(listed_codes(company_names(spark, sf_dir))),
                           industry_definitions(spark, sf_dir))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donations under the stored column names of the panel input."""
    d = donations(spark, sf_dir)
    who = donors(spark, sf_dir)
    names = company_names(spark, sf_dir).select(F.col("p_partkey").alias("part_id"), "employer")
    return (d.join(who, "donor_id").join(names, "part_id").select(
        F.col("donor_id").alias("bonica_cid"), F.col("recipient_id").alias("bonica_rid"),
        "cycle", F.col("order_id").alias("transaction_id"), "transaction_type", "amount",
        F.when(F.col("status") == "P", "C").otherwise("I").alias("contributor_type"),
        F.col("employer").alias("contributor_employer"),
        F.nullif(F.lower("priority"), F.lit("5-low")).alias("contributor_occupation"),
        F.col("city").alias("contributor_city"), F.col("zip").alias("contributor_zipcode"),
        F.col("static_score").alias("contributor_cfscore"),
        F.col("candidate_score").alias("candidate_cfscore"),
        F.col("segment").alias("contributor_gender")))


# Word lists that occur in the order priorities, in the roles of the occupation lists.
ENGINEER = ("medium", "not")
MANAGER = ("urgent", "high")
