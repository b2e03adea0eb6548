import pytest
from pyspark.sql import functions as F

from tallyweave.operators.crosswalk import (assign_codes, attach_industry, build_crosswalk,
                                            clean_code_list, code_universe, is_tech_12,
                                            is_tech_49, parse_definitions,
                                            read_definition_lines, residual_counts)
from tallyweave.operators.prefix import running_sum
from tallyweave.operators.quality import CheckFailed, crosswalk_checks, enforce, report
from tallyweave.sources.datasets import read_crosswalk_csv, write_crosswalk

TEXT = """stray line

 1 Agric  Agriculture
          0100-0199 Agric production - crops
          0200-0299
 2 Softw
          0150-0160 Small range

12 Other  Other
"""


@pytest.fixture(scope="module")
def definitions(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("defs")
    paths = {}
    for scheme in (12, 48, 49):
        path = folder / f"codes{scheme}.txt"
        path.write_text(TEXT)
        paths[scheme] = str(path)
    return parse_definitions(read_definition_lines(spark, paths)).cache()


def test_parse(definitions):
    rows = {(r["ff_num"], r["ff_abbr"], r["ff_name"], r["sic_from"], r["sic_to"],
             r["range_desc"]) for r in definitions.where("scheme = 49").collect()}
    assert rows == {(1, "Agric", "Agriculture", 100, 199, "Agric production - crops"),
                    (1, "Agric", "Agriculture", 200, 299, None),
                    (2, "Softw", "Softw", 150, 160, "Small range"),
                    (12, "Other", "Other", None, None, None)}


def test_narrowest_range_wins(spark, definitions):
    codes = code_universe(spark, 100, 400)
    got = {r["sic_int"]: (r["ff_abbr"], r["explicit"])
           for r in assign_codes(codes, definitions).where("scheme = 48").collect()}
    assert len(got) == 301
    assert got[155] == ("Softw", True) and got[120] == ("Agric", True)
    assert got[250] == ("Agric", True) and got[350] == ("Other", False)


def test_crosswalk(spark, definitions, tmp_path):
    raw = spark.createDataFrame([("SIC 155", " Office  of X ", "Sof tware"), ("155", "z", "z"),
                                 ("none", "a", "b"), ("9000", "c", "d")],
                                "sic string, office string, title string")
    listed = clean_code_list(raw)
    assert {(r["sic_int"], r["sec_office"]) for r in listed.collect()} == {
        (155, "Office of X"), (9000, "c")}
    x = build_crosswalk(code_universe(spark), listed, definitions).cache()
    assert x.count() == 9900
    row = x.where("sic_int = 155").first()
    assert (row["sic"], row["in_sec"], row["ff12"], row["ff49_abbr"], row["sic_detail"]) == (
        "0155", True, 2, "Softw", "Small range")
    assert residual_counts(x).first().asDict() == {
        "ff12_explicit": 1, "ff48_explicit": 1, "ff49_explicit": 1}
    bad = report([crosswalk_checks(x, 9900)])
    assert {r["name"]: r["violations"] for r in bad.collect()} == {
        "row_count": 0, "null_class": 0, "industries_12": 9, "industries_49": 0}
    with pytest.raises(CheckFailed):
        enforce(bad)
    write_crosswalk(x, str(tmp_path / "x"))
    back = read_crosswalk_csv(spark, str(tmp_path / "x" / "csv"), x.schema)
    assert back.where("sic = '0155'").count() == 1
    df = spark.createDataFrame([(1, "0155"), (2, "0120"), (3, None)], "id int, sic string")
    for only_listed, known in ((True, {1}), (False, {1, 2})):
        j = attach_industry(df, x, only_listed).select(
            "id", "ff12", is_tech_49(F.col("ff49_abbr")).alias("tech"),
            is_tech_12(F.col("ff12")).alias("tech12")).collect()
        assert {r["id"] for r in j if r["ff12"] is not None} == known
        assert {r["id"]: r["tech"] for r in j} == {1: True, 2: False, 3: False}
        assert [r["tech12"] for r in j if r["id"] == 3] == [None]


def test_running_sum_over_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") % 2).alias("s"), F.col("id").alias("p"))
    out = running_sum(df, "s", "p", F.lit(1), "n", block=64)
    assert all(r["n"] == r["p"] // 2 + 1 for r in out.collect())
