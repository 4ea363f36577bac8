"""Landed API documents derived from the driver tables.

Each builder turns driver rows into the JSON pages an API would return
(CRM pages of 200 records, page-database cursor pages, social statistics
documents, data-source catalogs). Pages group rows by a key range, so every
``collect_list`` holds at most one page worth of rows regardless of data
size or skew.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_end_ms, day_start_ms
from ..functions.nested import PAGE_RESPONSE_SCHEMA
from . import base

CRM_PAGE_SIZE = 200
ORDERS_PER_RESPONSE = 25
EVENTS_PER_DOC = 50
CUSTOMER_PAGES_PER_RESPONSE = 100
# Candidate property names, in the order they are tried.
KWH_NAMES = ["JVP (kWh)", "kWh p.a.", "kWh", "JVP"]
CUSTOMER_NAMES = ["Kunde", "kunde", "Customer", "Name"]
PROVISION_NAME = "Provision Gesamt"


def _json_string(c: Column) -> Column:
    """A string column as a JSON string literal (quoted, escaped)."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def crm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM deal pages: ``{"data": [...], "info": {"more_records", "page"}}``.

    ``Account_Name`` is an object, a string or absent, as in the API.
    """
    deals = base.crm_deals_from_orders(spark, sf_dir)
    k = F.col("lead_id")
    core = F.to_json(F.struct("Deal_Name", "Stage", "Amount", "Created_Time", "Closing_Date", "Pipeline"))
    acct = (F.when(k % 3 == 0, F.col("Account_Name"))
            .when(k % 3 == 1, _json_string(F.col("Account_Name"))))
    rec = F.when(acct.isNull(), core).otherwise(
        F.concat(F.substring(core, F.lit(1), F.length(core) - 1), F.lit(',"Account_Name":'), acct, F.lit("}")))
    pages = deals.select((k / CRM_PAGE_SIZE).cast("bigint").alias("page"), rec.alias("rec"))
    g = pages.groupBy("page").agg(F.array_join(F.collect_list("rec"), ",").alias("recs"))
    orders = base.read(spark, sf_dir, "orders").select("o_orderkey")
    last = orders.agg(F.max((F.col("o_orderkey") / CRM_PAGE_SIZE).cast("bigint")).alias("m")).select("m").scalar()
    more = F.when(F.col("page") < last, F.lit("true")).otherwise(F.lit("false"))
    doc = F.concat(F.lit('{"data":['), F.col("recs"), F.lit('],"info":{"more_records":'), more,
                   F.lit(',"page":'), F.col("page").cast("string"), F.lit("}}"))
    return g.select("page", doc.alias("doc"))


def _jkey(name: str) -> str:
    return json.dumps(name) + ":"


def _jnum(v: Column) -> Column:
    """A double as JSON number text (round-trips exactly)."""
    return v.cast("double").cast("string")


def _jtyped(kind: str, inner: Column | None = None) -> Column:
    """``{"type": kind, kind: inner}`` as text; ``inner`` is JSON text."""
    if inner is None:
        return F.lit('{"type":' + json.dumps(kind) + "}")
    return F.concat(F.lit('{"type":' + json.dumps(kind) + "," + _jkey(kind)), inner, F.lit("}"))


def _jnumber_prop(v: Column) -> Column:
    return F.concat(F.lit('{"type":"number","number":'), _jnum(v), F.lit("}"))


def _jtyped_number(kind: str, v: Column) -> Column:
    return _jtyped(kind, F.concat(F.lit('{"type":"number","number":'), _jnum(v), F.lit("}")))


def _jtext(kind: str, text: Column) -> Column:
    return _jtyped(kind, F.concat(F.lit('[{"plain_text":'), _json_string(text), F.lit("}]")))


def _jobject(pairs: list[tuple[Column, Column]]) -> Column:
    """JSON object text from (key JSON text incl. colon, value JSON text) pairs."""
    parts = []
    for i, (k, v) in enumerate(pairs):
        parts += ([F.lit(",")] if i else []) + [k, v]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _by_page(df: DataFrame, group: Column) -> tuple[DataFrame, Column]:
    """Hash-partition raw rows by their page key before documents are built.

    The page grouping needs this shuffle anyway; doing it on the narrow raw
    columns means the JSON text is built after the shuffle, in parallel, and
    the grouping below needs no second exchange. A fixed partition count keeps
    adaptive execution from collapsing the build into one task. Also returns
    the last page key, a scalar over the raw key column alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = df.agg(F.max(group).alias("m")).select("m").scalar()
    return df.withColumn("grp", group).repartition(n, "grp"), last


def _bodies(pages: DataFrame) -> DataFrame:
    """(grp, results): page JSON texts grouped by ``grp`` (bounded group size)."""
    return pages.groupBy("grp").agg(F.array_join(F.collect_list("page"), ",").alias("results"))


def _text_responses(pages: DataFrame, last: Column) -> DataFrame:
    """Cursor responses ``{"results": [...], "has_more", "next_cursor"}`` from
    page JSON texts grouped by ``grp``."""
    more = F.col("grp") < last
    doc = F.concat(F.lit('{"results":['), F.col("results"), F.lit('],"has_more":'),
                   F.when(more, F.lit("true")).otherwise(F.lit("false")),
                   F.when(more, F.concat(F.lit(',"next_cursor":"c'), (F.col("grp") + 1).cast("string"), F.lit('"')))
                   .otherwise(F.lit("")), F.lit("}"))
    return _bodies(pages).select("grp", doc.alias("doc"))


def _lineitem_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """One page per line item with a kWh property under one of four names and
    tags (number, formula, rollup, text, negative), a provision formula, a
    status select and a decoy; also the last ``grp``.

    Pages are written as JSON text directly (the shape an API returns), which
    is much cheaper than serialising a generic tagged-union struct."""
    li = base.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                     "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    li, last = _by_page(li, (F.col("l_orderkey") / ORDERS_PER_RESPONSE).cast("bigint"))
    ln, pk, sk = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    kwh = F.col("l_quantity") * 1000
    name1 = F.element_at(F.array(*[F.lit(_jkey(n)) for n in KWH_NAMES]), (ln % 4 + 1).cast("int"))
    p1 = (F.when(sk % 10 == 1, _jtext("rich_text", F.lit("n/a")))
          .when(sk % 10 == 0, _jnumber_prop(-kwh))
          .when(pk % 3 == 0, _jnumber_prop(kwh))
          .when(pk % 3 == 1, _jtyped_number("formula", kwh))
          .otherwise(_jtyped_number("rollup", kwh)))
    prov_v = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    p3 = _jtyped("select", F.concat(F.lit('{"name":'), _json_string(F.col("l_returnflag")), F.lit("}")))
    decoy_k = F.when(ln % 4 == 0, F.lit(_jkey("kWh"))).otherwise(F.lit(_jkey("Notiz")))
    decoy_v = F.when(ln % 4 == 0, _jnumber_prop(F.lit(1.0))).otherwise(_jtext("rich_text", F.lit("x")))
    props = _jobject([(name1, p1), (F.lit(_jkey(PROVISION_NAME)), _jtyped_number("formula", prov_v)),
                      (F.lit(_jkey("Status")), p3), (decoy_k, decoy_v)])
    page_id = F.concat_ws("-", F.lit("p"), F.col("l_orderkey"), ln)
    page = F.concat(F.lit('{"id":'), _json_string(page_id), F.lit(',"properties":'), props, F.lit("}"))
    return li.select("grp", page.alias("page")), last


def lineitem_page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-database cursor pages over the line items."""
    return _text_responses(*_lineitem_pages(spark, sf_dir))


def order_customer_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-database pages with a heterogeneous customer property
    (title, rich text, relation list, select, empty title) and a kWh number."""
    o = base.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o, last = _by_page(o, (F.col("o_orderkey") / CUSTOMER_PAGES_PER_RESPONSE).cast("bigint"))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("cust-"), ck.cast("string"))
    t = k % 5
    rel = F.concat(F.lit('[{"id":"rel-'), ck.cast("string"), F.lit('"},{"id":"rel-'), (ck % 50).cast("string"),
                   F.lit('"}]'))
    kunde = (F.when(t == 0, _jtext("title", name))
             .when(t == 1, _jtext("rich_text", name))
             .when(t == 2, _jtyped("relation", rel))
             .when(t == 3, _jtyped("select", F.concat(F.lit('{"name":'), _json_string(name), F.lit("}"))))
             .otherwise(_jtyped("title", F.lit("[]"))))
    key = F.when(k % 2 == 0, F.lit(_jkey("Kunde"))).otherwise(F.lit(_jkey("Customer")))
    kwh = _jnumber_prop(F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    status = _jtyped("select", F.concat(F.lit('{"name":'), _json_string(F.col("o_orderstatus")), F.lit("}")))
    props = _jobject([(key, kunde), (F.lit(_jkey("kWh")), kwh), (F.lit(_jkey("Status")), status)])
    page = F.concat(F.lit('{"id":"o-'), k.cast("string"), F.lit('","properties":'), props, F.lit("}"))
    pages = o.select("grp", page.alias("page"))
    return _text_responses(pages, last)


def social_stat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social statistics documents: per day and block of event ids, an
    ``elements[]`` array (missing counters absent) and an epoch-ms interval."""
    e = base.read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    e, _ = _by_page(e, (F.col("event_id") / EVENTS_PER_DOC).cast("bigint"))
    et = F.col("event_type")
    el = F.struct(
        F.struct((F.col("event_id") % 50 + 1).alias("impressionCount"),
                 F.when(et == "click", F.lit(1)).alias("clickCount"),
                 F.when(et == "purchase", F.col("value")).alias("engagement")).alias("totalShareStatistics"),
        F.when(et == "view", F.struct(F.struct(F.struct(F.lit(1).alias("pageViews")).alias("allPageViews"))
                                      .alias("views"))).alias("pageStatistics"))
    d = e.select(F.col("ts").cast("date").alias("day"), F.col("grp").alias("blk"), el.alias("el"))
    g = d.groupBy("day", "blk").agg(F.collect_list("el").alias("elements"))
    doc = F.to_json(F.struct("elements", F.struct(day_start_ms("day").alias("start"),
                                                  day_end_ms("day").alias("end")).alias("timeRange")))
    return g.select(doc.alias("doc"))


def picklist_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM field metadata: per brand a document whose ``fields[]`` are the part
    types of the brand, each with the sizes it comes in as a picklist."""
    p = base.read(spark, sf_dir, "part").select("p_brand", "p_type", "p_size").distinct()
    value = F.struct(F.concat(F.lit("Size "), F.col("p_size")).alias("display_value"), F.col("p_size").cast("string").alias("actual_value"))
    f = p.groupBy("p_brand", "p_type").agg(F.collect_list(value).alias("pick_list_values"))
    field = F.struct(F.col("p_brand").alias("api_name"), F.col("p_type").alias("display_label"), F.lit("picklist").alias("data_type"),
                     "pick_list_values")
    return f.groupBy("p_brand").agg(F.collect_list(field).alias("fields")).select(F.to_json(F.struct("fields")).alias("doc"))


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order with one property, of one of the nine tags or an unknown one; rollups and formulas also
    hold texts, dates and lists."""
    o = base.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = F.concat(F.lit("t-"), k.cast("string"))
    name = F.concat(F.lit('{"name":'), _json_string(F.col("o_orderpriority")), F.lit("}"))
    inner = lambda tag, v: F.concat(F.lit('{"type":"' + tag + '","' + tag + '":'), v, F.lit("}"))
    values = [_jnumber_prop(price), _jtext("title", text), _jtext("rich_text", text), _jtyped("select", name),
              _jtyped("status", name), _jtyped_number("rollup", price), _jtyped_number("formula", price),
              _jtyped("date", F.concat(F.lit('{"start":"2024-01-0'), (k % 9 + 1).cast("string"), F.lit('"}'))),
              _jtyped("relation", F.when(k % 2 == 0, F.lit('[{"id":"a"},{"id":"b"}]')).otherwise(F.lit("[]"))),
              _jtyped("formula", inner("string", _json_string(text))),
              _jtyped("formula", inner("boolean", F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")))),
              _jtyped("rollup", inner("date", F.lit('{"start":"2024-02-03"}'))), _jtyped("people")]
    kind = (k % len(values)).cast("int")
    prop = F.element_at(F.array(*values), kind + 1)
    return o.select("o_orderkey", kind.alias("kind"), F.concat(F.lit('{"Value":'), prop, F.lit("}")).alias("doc"))


def part_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-database catalogs with ``data_sources[]`` whose first usable id
    sits in ``id`` or ``data_source_id`` or nowhere."""
    p = base.read(spark, sf_dir, "part").select("p_partkey")
    pk = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 4

    def ds(i, d):
        return F.struct(i.cast("string").alias("id"), d.cast("string").alias("data_source_id"))

    none = F.lit(None)
    arr = (F.when(k == 0, F.array(ds(F.concat(F.lit("ds-"), pk), none)))
           .when(k == 1, F.array(ds(F.lit(""), F.concat(F.lit("dsx-"), pk)), ds(F.concat(F.lit("ds-"), pk), none)))
           .when(k == 2, F.array(ds(none, F.lit("")), ds(F.concat(F.lit("ds2-"), pk), none)))
           .otherwise(F.array().cast("array<struct<id:string,data_source_id:string>>")))
    return p.select(F.to_json(F.struct(F.concat(F.lit("db-"), pk).alias("id"), arr.alias("data_sources")))
                    .alias("doc"))


# --- landings with repeated, missing and trailing pages -------------------------------

#: A landed cursor response carries what it was asked for with, and the fetch that it is of. Which responses count
#: is decided without their pages, which stay JSON texts here.
LANDED_RESPONSE_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(T.StringType())),
    *[PAGE_RESPONSE_SCHEMA[c] for c in ("has_more", "next_cursor")],
    T.StructField("run", T.StringType()), T.StructField("start_cursor", T.StringType())])


def landed_crm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``crm_pages`` as a faulty landing: pages with number % 7 = 3 (but the last) are missing, pages with number
    % 5 = 0 landed twice, and pages 0 to 2 landed once more behind the end."""
    pages = crm_pages(spark, sf_dir)
    p = F.col("page")
    ends = F.col("doc").contains('"more_records":false')
    kept = pages.where((p % 7 != 3) | ends)
    last = base.read(spark, sf_dir, "orders").agg(F.max((F.col("o_orderkey") / CRM_PAGE_SIZE).cast("bigint")).alias("m")).select("m").scalar()
    info = F.concat(F.lit('"info":{"more_records":true,"page":'), (last + 1 + p).cast("string"), F.lit("}}"))
    behind = pages.where(p < 3).select((last + 1 + p).alias("page"), F.concat(F.substring_index("doc", '"info":', 1), info).alias("doc"))
    return kept.unionByName(kept.where(p % 5 == 0)).unionByName(behind).select("doc")


def landed_page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem_page_responses`` as two fetches. ``a``: the first half, ended regularly, with responses of group
    % 9 = 4 landed twice and three responses that nothing leads to. ``b``: the rest without those of group % 11 = 5
    (but its first and last)."""
    pages, top = _lineitem_pages(spark, sf_dir)
    mid, g = F.floor(top / 2), F.col("grp")

    def told(run: str, cursor: Column, following: Column) -> Column:
        """The response with its fetch, its cursor (or null) and the next one's (or none)."""
        head = F.concat(F.lit('{"run":"' + run + '","start_cursor":'), F.coalesce(F.concat(F.lit('"'), cursor, F.lit('"')), F.lit("null")), F.lit(","))
        tail = F.coalesce(F.concat(F.lit(',"has_more":true,"next_cursor":"'), following, F.lit('"}')), F.lit(',"has_more":false}'))
        return F.concat(head, F.lit('"results":['), F.col("results"), F.lit("]"), tail)

    name = lambda k, c: F.concat(F.lit(c), k.cast("string"))
    first = told("a", F.when(g > 0, name(g, "c")), F.when(g < mid, name(g + 1, "c")))
    stray = told("a", name(g, "t"), F.when(g < 2, name(g + 1, "t")))
    second = told("b", F.when(g > mid + 1, name(g, "c")), F.when(g < top, name(g + 1, "c")))
    kept = (g % 11 != 5) | (g == mid + 1) | (g == top)
    # every body is built once and gives the responses that it is in
    docs = F.array(F.when(g <= mid, first), F.when((g <= mid) & (g % 9 == 4), first), F.when((g <= mid) & (g < 3), stray),
                   F.when((g > mid) & kept, second))
    return _bodies(pages).select(F.explode(F.array_compact(docs)).alias("doc"))
