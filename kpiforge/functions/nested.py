"""Nested-document expressions (SCL-16, SCL-17, SCL-19).

Page-database properties are tagged unions: a struct with a ``type`` field
and one nullable field per tag. They are read with a declared schema (no
inference) and taken apart with CASE expressions, JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.ArrayType(T.StructType([T.StructField("plain_text", T.StringType())]))
_NAMED = T.StructType([T.StructField("name", T.StringType())])
_DATE = T.StructType([T.StructField("start", T.StringType())])
# a computed value: a number, or one of the other kinds
_COMPUTED = T.StructType([T.StructField("type", T.StringType()), T.StructField("number", T.DoubleType()),
                          T.StructField("string", T.StringType()), T.StructField("boolean", T.BooleanType()),
                          T.StructField("date", _DATE)])
COMPUTED_TEXT_LENGTH = 80
# Fixed value: the text of a relation is its count followed by this.
RELATION_TEXT = " Verknüpfung(en)"

PROPERTY_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("number", T.DoubleType()),
    T.StructField("title", _TEXT),
    T.StructField("rich_text", _TEXT),
    T.StructField("select", _NAMED),
    T.StructField("status", _NAMED),
    T.StructField("rollup", _COMPUTED),
    T.StructField("formula", _COMPUTED),
    T.StructField("date", _DATE),
    T.StructField("relation", T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))),
])

PAGE_TYPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), PROPERTY_TYPE)),
])

# cursor-paged page-database response (SRC-8)
PAGE_RESPONSE_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(PAGE_TYPE)),
    T.StructField("has_more", T.BooleanType()),
    T.StructField("next_cursor", T.StringType()),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prop_number(p, types=("number", "formula", "rollup")) -> Column:
    """Numeric value of a property: number, or numeric rollup / formula
    (only the tags listed in ``types``); else NULL."""
    p = _c(p)
    t = p.getField("type")
    out = None
    for tag in types:
        if tag == "number":
            cond, val = t == "number", p.getField("number")
        else:
            cond = (t == tag) & (p.getField(tag).getField("type") == "number")
            val = p.getField(tag).getField("number")
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def prop_text(p) -> Column:
    """SCL-16: readable text value of a property over the nine tags. A rollup or
    formula that is not a number gives its JSON text, cut to 80 characters."""
    p = _c(p)
    t = p.getField("type")
    first_text = lambda f: F.coalesce(F.get(p.getField(f), 0).getField("plain_text"), F.lit(""))
    rels = p.getField("relation")

    def computed(tag: str) -> Column:
        v = p.getField(tag)
        return F.when(v.getField("type") == "number", v.getField("number").cast("string")).otherwise(
            F.substring(F.to_json(v), 1, COMPUTED_TEXT_LENGTH))

    return (F.when(t == "number", p.getField("number").cast("string"))
            .when(t == "title", first_text("title"))
            .when(t == "rich_text", first_text("rich_text"))
            .when(t == "select", p.getField("select").getField("name"))
            .when(t == "status", p.getField("status").getField("name"))
            .when(t == "rollup", computed("rollup"))
            .when(t == "formula", computed("formula"))
            .when(t == "date", p.getField("date").getField("start"))
            .when(t == "relation",
                  F.when(F.coalesce(F.size(rels), F.lit(0)) > 0,
                         F.concat(F.size(rels).cast("string"), F.lit(RELATION_TEXT)))
                  .otherwise(F.lit("0")))
            .otherwise(F.concat(F.lit("("), F.coalesce(t, F.lit("")), F.lit(")"))))


def prop_ids(p) -> Column:
    """AGG-12: the identities a property names, as ``array<string>``.

    title / rich_text / select -> [first text or name]; relation -> all ids;
    empty text arrays and other tags -> [].
    """
    p = _c(p)
    t = p.getField("type")
    first_text = lambda f: F.get(p.getField(f), 0).getField("plain_text")
    one = lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))
    return (F.when(t == "title", one(F.when(F.size(p.getField("title")) > 0, F.coalesce(first_text("title"), F.lit("")))))
            .when(t == "rich_text", one(F.when(F.size(p.getField("rich_text")) > 0,
                                               F.coalesce(first_text("rich_text"), F.lit("")))))
            .when(t == "relation", F.transform(
                F.coalesce(p.getField("relation"), F.array().cast("array<struct<id:string>>")),
                lambda r: F.coalesce(r.getField("id"), F.lit(""))))
            .when(t == "select", one(F.when(p.getField("select").isNotNull(),
                                            F.coalesce(p.getField("select").getField("name"), F.lit("")))))
            .otherwise(F.array().cast("array<string>")))


def first_present(props, names: list[str]) -> Column:
    """SCL-17: the first property present among candidate names.

    Stops at the first present key even when its value is unusable, as the
    reference's loop does (``break`` after the first hit).
    """
    m = _c(props)
    return F.coalesce(*[m.getItem(n) for n in names])
