"""Stored schemas. Dots in source column names become underscores.

Fixed values: the column lists and types of the donation tables and of the company register.
"""

from __future__ import annotations

from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

_TYPES = {"string": StringType(), "bigint": LongType(), "double": DoubleType(),
          "date": DateType(), "int": IntegerType()}

_CONTRIBUTIONS = """
transaction.id string
transaction.type string
amount double
date date
bonica.cid bigint
contributor.name string
contributor.lname string
contributor.fname string
contributor.mname string
contributor.suffix string
contributor.title string
contributor.ffname string
contributor.type string
contributor.gender string
contributor.address string
contributor.city string
contributor.state string
contributor.zipcode string
contributor.occupation string
contributor.employer string
occ.standardized string
is.corp string
recipient.name string
bonica.rid string
recipient.party string
recipient.type string
recipient.state string
seat string
election.type string
latitude double
longitude double
gis.confidence double
contributor.district string
censustract string
efec.memo string
efec.memo2 string
efec.transaction.id.orig string
bk.ref.transaction.id string
efec.org.orig string
efec.comid.orig string
efec.form.type string
excluded.from.scaling bigint
contributor.cfscore double
candidate.cfscore double
"""

_CONTRIBUTORS = """
bonica.cid bigint
contributor.type string
num.distinct bigint
most.recent.contributor.name string
most.recent.contributor.address string
most.recent.contributor.city string
most.recent.contributor.zipcode string
most.recent.contributor.state string
most.recent.contributor.latitude double
most.recent.contributor.longitude double
most.recent.contributor.occupation string
most.recent.contributor.employer string
most.recent.transaction.id string
most.recent.transaction.date date
contributor.gender string
is.corp string
contributor.cfscore double
is.projected string
first_cycle_active bigint
last_cycle_active bigint
"""

FIRST_CYCLE, LAST_CYCLE = 1979, 2024
REGISTER_JSON = "cik string, name string, sic string, sicDescription string"


def plain(name: str) -> str:
    return name.replace(".", "_")


def _parse(text: str) -> StructType:
    fields = []
    for line in text.split("\n"):
        if line.strip():
            name, kind = line.split()
            fields.append(StructField(plain(name), _TYPES[kind], True, {"source_name": name}))
    return StructType(fields)


CONTRIBUTIONS = _parse(_CONTRIBUTIONS)
CONTRIBUTORS = StructType([
    *_parse(_CONTRIBUTORS).fields,
    *[StructField(f"amount_{y}", DoubleType(), True, {"source_name": f"amount.{y}"})
      for y in range(1980, 2025, 2)]])
STORED_CONTRIBUTIONS = StructType([*CONTRIBUTIONS.fields, StructField("cycle", LongType())])

# Columns the panel needs.
PANEL_INPUT = ("bonica_cid", "bonica_rid", "cycle", "transaction_id", "transaction_type",
               "amount", "contributor_type", "contributor_employer", "contributor_occupation",
               "contributor_city", "contributor_zipcode", "contributor_cfscore",
               "candidate_cfscore", "contributor_gender")
