"""Statement payloads: stored JSON, parsed with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.functions.spans import keyed_objects

INCOME = "displayPeriod STRING, qIncTrev DOUBLE, incTrev DOUBLE, qIncEbi DOUBLE, qIncEbit DOUBLE, incEbi DOUBLE, incEbit DOUBLE, qIncNinc DOUBLE, incNinc DOUBLE, qIncEps DOUBLE, incEps DOUBLE"
BALANCE = "displayPeriod STRING, balTeq DOUBLE, balTdeb DOUBLE, balCsti DOUBLE, balTota DOUBLE, balTca DOUBLE, balTcl DOUBLE, balTinv DOUBLE, balTrec DOUBLE, balNppe DOUBLE"
CASHFLOW = "displayPeriod STRING, cafCfoa DOUBLE, cafCexp DOUBLE, cafFcf DOUBLE"
SCHEMAS = {"income": INCOME, "balancesheet": BALANCE, "cashflow": CASHFLOW}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """symbol, endpoint, payload (JSON text), status from JSON lines; what could not be fetched has a status of its own."""
    raw = spark.read.schema("symbol STRING, endpoint STRING, payload STRING, status STRING").json(path)
    return raw.withColumn("status", F.coalesce("status", F.when(F.col("payload").isNull(), "unavailable").otherwise("ok")))


def number(value: Column) -> Column:
    """A variant's value if it is a JSON number; text and booleans are null."""
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def periods(payloads: DataFrame, kind: str) -> DataFrame:
    """symbol, ordinal (0 is the oldest) and the typed fields of every period of an array payload.

    A payload may be the array itself or an envelope with it under `data`; what is no object is no period, and
    text where a number is due is null.
    """
    names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
    said = F.try_parse_json("payload")
    every = F.coalesce(F.try_variant_get(said, "$", "array<variant>"), F.try_variant_get(said, "$.data", "array<variant>"))
    rows = payloads.filter("status = 'ok'").select("symbol", F.posexplode(every).alias("ordinal", "p")).filter(F.schema_of_variant("p").startswith("OBJECT"))
    return rows.select("symbol", "ordinal", F.try_variant_get("p", "$.displayPeriod", "string").alias("displayPeriod"), *(number(F.try_variant_get("p", f"$.{n}", "variant")).alias(n) for n in names[1:]))


def either(*names: str) -> Column:
    """The first of several spellings of a field that has a value."""
    return F.coalesce(*names)


def comment_lines(payload: Column, most: int) -> Column:
    """The string values of all `_comments` objects of a payload at any depth, each once in first-seen order, at most so many.

    Brackets, quotes and the key itself inside strings count as text; an object that is not JSON gives nothing.
    """
    objects = F.transform(keyed_objects(F.coalesce(payload, F.lit(""))), lambda o: F.when(F.json_object_keys(o).isNotNull(), o))
    values = F.flatten(F.transform(objects, lambda o: F.coalesce(F.map_values(F.from_json(o, "MAP<STRING, VARIANT>")), F.array().cast("array<variant>"))))
    texts = F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    return F.slice(F.array_distinct(texts), 1, most)
