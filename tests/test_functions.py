import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge import functions as fx
from kpiforge.functions.nested import PROPERTY_TYPE

# FIXTURES §3 number parsing table (ours: inf / nan / 1_000 are bad values)
PARSE_CASES = [
    ("5.13", 5.13), ("5,13", 5.13), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234", 1.234),
    ("1,234,567", 0.0), ("1.234.567", 0.0), ("-5,13", -5.13), (" 7 ", 7.0), ("", 0.0), ("None", 0.0),
    (None, 0.0), ("5 €", 0.0), ("abc", 0.0), ("5d", 0.0), ("5f", 0.0), ("1e5", 100000.0), ("inf", 0.0),
    ("nan", 0.0), ("1_000", 0.0), (" 7,5 ", 7.5), ("+3", 3.0), (".5", 0.5), ("12.", 12.0),
]


def test_parse_number_rule_table(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _e) in enumerate(PARSE_CASES)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", fx.parse_number("s").alias("v")).collect()}
    for i, (s, expected) in enumerate(PARSE_CASES):
        assert got[i] == pytest.approx(expected), (s, got[i])


def test_parse_number_null_mode(spark):
    df = spark.createDataFrame([("abc",), ("5,5",), (None,)], "s string")
    got = [r.v for r in df.select(fx.parse_number("s", on_bad="null").alias("v")).collect()]
    assert got == [None, 5.5, None]


def test_coerce_number_no_comma(spark):
    df = spark.createDataFrame([("12.5",), ("12,5",), (" 3 ",), ("n/a",)], "s string")
    assert [r.v for r in df.select(fx.coerce_number("s").alias("v")).collect()] == [12.5, None, 3.0, None]


def test_name_of_three_shapes(spark):
    df = spark.createDataFrame([('{"name": "ACME", "id": "1"}',), ("Plain Co",), (None,), ('{"id": "2"}',)], "a string")
    assert [r.n for r in df.select(fx.name_of("a").alias("n")).collect()] == ["ACME", "Plain Co", "", ""]


def test_full_name(spark):
    df = spark.createDataFrame([("Ada", "Lovelace"), (None, "Solo"), ("Only", None), (None, None)], "f string, l string")
    assert [r.n for r in df.select(fx.full_name("f", "l").alias("n")).collect()] == ["Ada Lovelace", "Solo", "Only", ""]


LEAD_CASES = [
    ("Gewonnen, Freigabe erhalten", "2020-01-01", "won"),
    ("Abgeschlossen, gewonnen", None, "won"),
    ("Abgewickelt, -> OPS", "2026-01-10", "won"),
    ("Abgeschlossen, verloren", "2026-01-10", "lost"),
    ("Warteschleife", "2026-01-10", "waiting"),
    ("Qualifizierung", "2026-01-01", "new"),
    ("Qualifizierung", "2025-12-31", "active"),
    ("Qualifizierung", None, "active"),
]


def test_lead_status_table(spark):
    df = spark.createDataFrame([(s, c) for s, c, _ in LEAD_CASES], "stage string, created string")
    got = [r.s for r in df.select(fx.lead_status("stage", F.to_date("created"), dt.date(2026, 1, 15)).alias("s"))
           .collect()]
    assert got == [e for _s, _c, e in LEAD_CASES]


def test_on_track_status_table(spark):
    df = spark.createDataFrame([(50.0,), (49.9,), (35.0,), (34.9,)], "ytd double")
    got = [r.s for r in df.select(fx.on_track_status("ytd", F.lit(100.0), F.lit(0.5)).alias("s")).collect()]
    assert got == ["on_track", "slightly_behind", "slightly_behind", "behind"]


def test_null_target_is_behind_not_nan(spark):
    df = spark.createDataFrame([(10.0, None)], "ytd double, t double")
    r = df.select(fx.on_track_status("ytd", "t", F.lit(0.5)).alias("s"),
                  fx.attainment_pct("ytd", "t").alias("p")).first()
    assert r.s == "behind" and r.p == 0.0


def test_attainment_band_and_progress_cap(spark):
    df = spark.createDataFrame([(150.0, 100.0), (100.0, 100.0), (70.0, 100.0), (69.0, 100.0), (5.0, 0.0)],
                               "v double, t double")
    out = df.select(fx.progress_record("v", "t").alias("r")).collect()
    assert [(r.r.percentage, r.r.band) for r in out] == [
        (120.0, "success"), (100.0, "success"), (70.0, "warning"), (69.0, "danger"), (0.0, "danger")]


def test_dates(spark):
    df = spark.createDataFrame([("20280315",), ("bad",)], "s string")
    r = df.select(fx.yyyymmdd_to_date("s").alias("d")).collect()
    assert r[0].d == dt.date(2028, 3, 15) and r[1].d is None
    d = spark.createDataFrame([(dt.date(2028, 12, 31), ), (dt.date(2026, 1, 3),)], "d date")
    out = d.select(fx.days_in_year("d").alias("n"), fx.year_progress("d").alias("p"),
                   fx.weekend_factor("d").alias("w"), fx.month_key("d").alias("m"),
                   fx.day_start_ms("d").alias("s"), fx.day_end_ms("d").alias("e")).collect()
    assert out[0].n == 366 and out[0].p == 1.0 and out[0].m == "2028-12"
    assert out[1].n == 365 and out[1].w == 0.6  # 2026-01-03 is a Saturday
    assert out[1].e - out[1].s == 86_400_000
    iso = spark.createDataFrame([("2026-01-05T23:10:00+02:00",), (None,)], "t string")
    assert [r.d for r in iso.select(fx.iso_date_prefix("t").alias("d")).collect()] == [dt.date(2026, 1, 5), None]


def test_round_helpers(spark):
    df = spark.createDataFrame([(0.285,), (2.675,), (2.5,)], "x double")
    r = df.select(fx.round_half_up("x", 2).alias("u"), fx.round_half_even("x", 0).alias("e")).collect()
    assert [x.u for x in r] == [0.29, 2.68, 2.5]
    assert r[2].e == 2.0


def _props(spark, entries):
    schema = f"p map<string, {PROPERTY_TYPE.simpleString()}>"
    return spark.createDataFrame([(entries,)], schema)


def test_prop_text_and_first_present(spark):
    props = {
        "kWh": {"type": "number", "number": 5.0},
        "JVP (kWh)": {"type": "rich_text", "rich_text": []},
        "t": {"type": "title", "title": [{"plain_text": "Hello"}]},
        "r": {"type": "relation", "relation": [{"id": "a"}, {"id": "b"}]},
        "f": {"type": "formula", "formula": {"type": "string", "number": None}},
        "x": {"type": "people"},
    }
    df = _props(spark, props)
    p = F.col("p")
    out = df.select(
        fx.prop_text(p["t"]).alias("t"), fx.prop_text(p["r"]).alias("r"), fx.prop_text(p["x"]).alias("x"),
        fx.prop_text(p["JVP (kWh)"]).alias("empty"),
        # first present wins even when unusable (the rich_text one), as the reference's loop does
        fx.prop_number(fx.first_present(p, ["JVP (kWh)", "kWh"])).alias("first"),
        fx.prop_number(fx.first_present(p, ["nope", "kWh"])).alias("second"),
        fx.prop_number(p["f"]).alias("f"),
    ).first()
    assert (out.t, out.r, out.x, out.empty) == ("Hello", "2 Verknüpfung(en)", "(people)", "")
    assert out.first is None and out.second == 5.0 and out.f is None


def test_prop_ids(spark):
    props = {"a": {"type": "relation", "relation": [{"id": "x"}, {"id": "y"}]},
             "b": {"type": "title", "title": []},
             "c": {"type": "select", "select": {"name": "S"}},
             "d": {"type": "select", "select": None}}
    df = _props(spark, props)
    p = F.col("p")
    r = df.select(*[fx.prop_ids(p[k]).alias(k) for k in "abcd"]).first()
    assert (r.a, r.b, r.c, r.d) == (["x", "y"], [], ["S"], [])


def test_clean_key_clamp_and_gauge_edges(spark):
    df = spark.createDataFrame([(" 2026-01-01 ", -5.0, 130.0, 100.0)], "k string, a double, b double, t double")
    r = df.select(fx.clean_key("k").alias("k"), fx.clamp("a", low=0).alias("a"), fx.clamp("b", high=120).alias("b"),
                  *fx.gauge_edges("t")).first()
    assert (r.k, r.a, r.b) == ("2026-01-01", 0.0, 120.0)
    assert (r.edge_warning, r.edge_success, r.edge_max) == (70.0, 100.0, 120.0)
    assert spark.range(1).select(fx.month_share(F.lit(1200.0)).alias("m")).first().m == 100.0
    assert spark.range(1).select(fx.kwh_to_gwh(F.lit(2_500_000.0)).alias("g")).first().g == 2.5


def test_bounce_with_fallback(spark):
    df = spark.createDataFrame([(40.0, 70.0), (None, 70.0), (None, None)], "b double, e double")
    assert [r.v for r in df.select(fx.bounce_with_fallback("b", "e").alias("v")).collect()] == [40.0, 30.0, None]


def test_size_partitions(spark):
    from kpiforge.session import size_partitions
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        n = size_partitions(spark, 100 * 1024**4)          # 100 TiB at 128 MiB per partition
        assert n == 819200 and spark.conf.get("spark.sql.shuffle.partitions") == "819200"
        assert size_partitions(spark, 10) == spark.sparkContext.defaultParallelism
    finally:
        for k in ["spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                  "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_day_bounds_and_utc_instant_ignore_session_zone(spark):
    import datetime as _dt
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = []
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame([(_dt.datetime(2024, 3, 10, 23, 30, 15, 250000),)], "ts timestamp_ntz")
            r = df.select(fx.day_start_ms(F.col("ts").cast("date")).alias("s"), fx.day_end_ms(F.col("ts").cast("date")).alias("e"),
                          F.unix_micros(fx.utc_instant("ts")).alias("u"),
                          fx.date_of_ms(fx.day_start_ms(F.col("ts").cast("date"))).alias("d")).first()
            out.append(tuple(r))
        assert out[0] == out[1] == out[2]
        assert out[0][0] == 19792 * 86_400_000 and out[0][3] == _dt.date(2024, 3, 10)
        assert out[0][2] == 19792 * 86_400_000_000 + (23 * 3600 + 30 * 60 + 15) * 1_000_000 + 250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
