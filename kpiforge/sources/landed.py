"""Landed API documents (SRC-6..9, SRC-13, SRC-17).

The reference pages through live APIs; here each API response is a landed
JSON document (one file or one text row per page). Every page is read in
parallel with a declared schema and exploded; no pagination loop runs on
the driver. ``read_landed`` reads a folder of page files; ``parse_landed``
parses a column of page texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import PAGE_RESPONSE_SCHEMA  # noqa: F401  (re-exported)

CRM_RECORD = T.StructType([
    T.StructField("Deal_Name", T.StringType()),
    T.StructField("Account_Name", T.StringType()),  # raw JSON text: object, text or null
    T.StructField("Stage", T.StringType()),
    T.StructField("Amount", T.DoubleType()),
    T.StructField("Created_Time", T.StringType()),
    T.StructField("Closing_Date", T.StringType()),
    T.StructField("Pipeline", T.StringType()),
])

CRM_PAGE_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(CRM_RECORD)),
    T.StructField("info", T.StructType([T.StructField("more_records", T.BooleanType()),
                                        T.StructField("page", T.LongType())])),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("data_sources", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("data_source_id", T.StringType())]))),
])

STATS_ELEMENT = T.StructType([
    T.StructField("totalShareStatistics", T.StructType([
        T.StructField("impressionCount", T.LongType()),
        T.StructField("clickCount", T.LongType()),
        T.StructField("engagement", T.DoubleType())])),
    T.StructField("pageStatistics", T.StructType([
        T.StructField("views", T.StructType([
            T.StructField("allPageViews", T.StructType([T.StructField("pageViews", T.LongType())]))]))])),
])

STATS_SCHEMA = T.StructType([
    T.StructField("elements", T.ArrayType(STATS_ELEMENT)),
    T.StructField("timeRange", T.StructType([T.StructField("start", T.LongType()),
                                             T.StructField("end", T.LongType())])),
])

FIELDS_SCHEMA = T.StructType([
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("api_name", T.StringType()),
        T.StructField("display_label", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("pick_list_values", T.ArrayType(T.StructType([
            T.StructField("display_value", T.StringType()),
            T.StructField("actual_value", T.StringType())]))),
    ]))),
])


def read_landed(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """Read a folder of landed page files with a declared schema (no inference)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def parse_landed(df: DataFrame, col: str, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Parse a column of page texts into the page struct's fields."""
    keep = list(keep or [])
    return df.select(*keep, F.from_json(F.col(col), schema).alias("_p")).select(*keep, "_p.*")


def crm_records(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SRC-6 / SET-1: the union of all pages' ``data[]`` records (PRJ-5: the
    declared record schema is the column list)."""
    keep = list(keep or [])
    return pages.select(*keep, F.explode("data").alias("r")).select(*keep, "r.*")


def crm_record_count(pages: DataFrame) -> DataFrame:
    """SRC-7: number of records over all pages without exploding them."""
    return pages.agg(F.coalesce(F.sum(F.size("data")), F.lit(0)).cast("bigint").alias("records"),
                     F.count(F.lit(1)).alias("pages"))


def page_results(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SRC-8: the union of all cursor pages' ``results[]``."""
    keep = list(keep or [])
    return responses.select(*keep, F.explode("results").alias("r")).select(*keep, "r.*")


def first_data_source_id(catalogs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SRC-9: the first child whose ``id`` (else ``data_source_id``) is non-empty.

    A higher-order ``filter`` + ``element_at`` inside each row, so no
    explode or shuffle is needed.
    """
    keep = list(keep or [])
    ids = F.transform("data_sources", lambda s: F.coalesce(F.nullif(s["id"], F.lit("")),
                                                           F.nullif(s["data_source_id"], F.lit(""))))
    usable = F.filter(ids, lambda x: x.isNotNull())
    return catalogs.select(*keep, F.when(F.size(usable) > 0, F.element_at(usable, 1)).alias("first_id"))


def property_inventory(pages: DataFrame, props: str = "properties") -> DataFrame:
    """SRC-17: property names with their tag types and the number of pages using them."""
    e = pages.select(F.explode(F.map_entries(props)).alias("e"))
    return e.groupBy(F.col("e.key").alias("name"), F.col("e.value.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n_pages"))


def picklist_values(fields_docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """SRC-17: field metadata (optionally only wanted fields) with one row per picklist value."""
    f = fields_docs.select(F.explode("fields").alias("f")).select("f.*")
    if wanted:
        f = f.where(F.col("api_name").isin(*wanted))
    return f.select("api_name", "display_label", "data_type",
                    F.explode_outer("pick_list_values").alias("v")).select(
        "api_name", "display_label", "data_type", F.col("v.display_value").alias("display_value"),
        F.col("v.actual_value").alias("actual_value"))


def stats_in_interval(docs: DataFrame, start_ms, end_ms) -> DataFrame:
    """SRC-13: documents whose interval start lies in ``[start_ms, end_ms)``."""
    s = F.col("timeRange.start")
    return docs.where((s >= start_ms) & (s < end_ms))
