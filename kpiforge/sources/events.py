"""Metric reports computed from an event table (SRC-10, SRC-11, SRC-12, SRC-14).

The reference receives these numbers ready-made from analytics and
identity APIs; computing them from raw events needs definitions it does
not contain. Our documented choices:

* session: a user's events with gaps of at most ``gap_minutes`` (30);
* bounce: a session of a single event;
* monthly active users on day d: distinct users with an event in
  ``[d - 29, d]``.

Events without a user (NULL) count as events and pageviews, on every report;
they belong to no session and are neither visitors nor active users.

Scale notes. Sessions need each event's predecessor per user, but two events
of a user in one bucket no wider than the session gap are never split, so a
session can start only at a bucket's first event. Events are reduced map-side
to one row per (group, user, day, bucket), whatever a user's share of them,
and only these rows meet in a window. MAU uses disjoint coverage intervals and
a difference array, so its work is linear in distinct (user, day) pairs
instead of 30 times that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date_lit


def session_buckets(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type",
                    pageview: str = "view", gap_minutes: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """One row per (``by``, user, day, bucket of the gap's width): first and
    last time, events, pageviews, and whether a session starts there
    (``is_start``) and is a single event (``is_bounce``).

    A new session starts when the user's previous event in the group is absent
    or more than ``gap_minutes`` earlier.
    """
    if gap_minutes < 1:
        raise ValueError("gap_minutes must be at least 1")
    by, gap = list(by), F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    t = F.col(ts)
    bucket = F.floor(F.unix_seconds(t.cast("timestamp")) / (60 * int(gap_minutes)))
    b = events.groupBy(*by, F.col(user).alias("_u"), t.cast("date").alias("date"), bucket.alias("_b")).agg(
        F.min(t).alias("_first"), F.max(t).alias("_last"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col(kind) == pageview).alias("pageviews"))
    known = F.col("_u").isNotNull()
    # events without a user have no neighbours; by bucket, their rows don't meet in one task
    w = Window.partitionBy(*by, "_u", F.when(~known, F.col("_b"))).orderBy("_first")
    prev, nxt = F.lag("_last").over(w), F.lead("_first").over(w)
    b = b.withColumns({"_prev": prev, "_next": nxt})
    start = known & (F.col("_prev").isNull() | (F.col("_first") > F.col("_prev") + gap))
    ends = F.col("_next").isNull() | (F.col("_next") > F.col("_last") + gap)
    return b.withColumns({"is_start": start, "is_bounce": start & (F.col("events") == 1) & ends}).drop("_prev", "_next")


def t_type(df: DataFrame, col: str) -> str:
    """Simple type name of a column (timestamp or timestamp_ntz)."""
    return df.schema[col].dataType.simpleString()


def _metric_aggs() -> list[Column]:
    return [
        F.count_distinct("_u").alias("visitors"),
        F.count_if("is_start").alias("sessions"),
        F.count_if("is_bounce").alias("bounces"),
        F.sum("pageviews").alias("pageviews"),
        F.sum("events").alias("events"),
    ]


def rates(df: DataFrame) -> DataFrame:
    s = F.col("sessions").cast("double")
    bounce = F.when(s > 0, F.col("bounces").cast("double") * 100 / s).otherwise(F.lit(0.0))
    return df.select("*", bounce.alias("bounce_rate"))


def daily_metrics(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type",
                  pageview: str = "view", gap_minutes: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """SRC-11: one metric row per day (sessions counted on their start day)."""
    b = session_buckets(events, user, ts, kind, pageview, gap_minutes, by)
    return rates(b.groupBy(*by, "date").agg(*_metric_aggs()))


def range_metrics(events: DataFrame, as_of, ranges: Sequence[tuple[str, int, int]], user: str = "user_id",
                  ts: str = "ts", kind: str = "event_type", pageview: str = "view",
                  gap_minutes: int = 30) -> DataFrame:
    """SRC-10 / SRC-12: totals for several relative ranges side by side.

    ``ranges`` holds ``(label, days_back_start, days_back_end)`` relative to
    ``as_of`` (``("yesterday", 1, 1)``, ``("last_7_days", 7, 1)``). Each bucket
    row is tagged with the ranges containing its day through an in-row filtered
    array and exploded (at most ``len(ranges)`` copies), so no join with the
    ranges is needed for the aggregation; the literal range list is joined
    afterwards so that empty ranges report zeros.
    """
    a = as_date_lit(as_of)
    spec = F.array(*[F.struct(F.lit(lbl).alias("label"), F.date_sub(a, s).alias("start"),
                              F.date_sub(a, e).alias("end")) for lbl, s, e in ranges])
    # only events within a session gap of the requested ranges can affect them;
    # the bound is pushed into the scan
    margin = -(-int(gap_minutes) // 1440)
    lo = F.date_sub(a, max(s for _l, s, _e in ranges) + margin)
    hi = F.date_sub(a, min(e for _l, _s, e in ranges) - margin - 1)
    t = F.col(ts)
    events = events.where((t >= lo.cast(t_type(events, ts))) & (t < hi.cast(t_type(events, ts))))
    b = session_buckets(events, user, ts, kind, pageview, gap_minutes)
    day = F.col("date")
    tagged = b.select("*", F.explode(F.filter(spec, lambda r: (day >= r["start"]) & (day <= r["end"])))
                      .alias("_r")).select("*", F.col("_r.label").alias("label"))
    agg = tagged.groupBy("label").agg(*_metric_aggs())
    spark = events.sparkSession
    labels = F.broadcast(spark.createDataFrame([(lbl, i + 1) for i, (lbl, _s, _e) in enumerate(ranges)],
                                               "label string, pos int"))
    j = labels.join(agg, "label", "left")
    zero = ["visitors", "sessions", "bounces", "pageviews", "events"]
    return rates(j.select("label", "pos", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in zero]))


def monthly_active_users(events: DataFrame, user: str = "user_id", ts: str = "ts", window_days: int = 30,
                         by: Sequence[str] = ()) -> DataFrame:
    """SRC-14: distinct active users in the trailing ``window_days`` days, for
    every day between the first and last day with a known user.

    Each (user, active day a) covers days ``[a, min(a + window_days - 1,
    next active day - 1)]``; these intervals are disjoint per user, so the
    count on day d is a running sum of +1/-1 interval edges. Both edges come
    from one explode, and days without an edge are filled from the row before,
    so events are scanned once and nothing is joined. The windows run over
    one user's distinct active days and over the calendar.
    """
    by = list(by)
    ud = events.where(F.col(user).isNotNull()).select(
        *by, F.col(user).alias("_u"), F.col(ts).cast("date").alias("_a")).distinct()
    full = F.date_add("_a", window_days)
    nxt = F.lead("_a").over(Window.partitionBy(*by, "_u").orderBy("_a"))
    iv = ud.select(*by, "_a", F.least(full, F.coalesce(nxt, full)).alias("_e"))
    edges = F.array(F.struct(F.col("_a").alias("date"), F.lit(1).alias("d"), F.col("_a").alias("active")),
                    F.struct(F.col("_e").alias("date"), F.lit(-1).alias("d"), F.lit(None).cast("date").alias("active")))
    per_day = iv.select(*by, F.explode(edges).alias("x")).groupBy(*by, "x.date").agg(
        F.sum("x.d").alias("d"), F.max("x.active").alias("active"))
    order = Window.partitionBy(*by).orderBy("date")
    running = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    last = F.max("active").over(Window.partitionBy(*by))
    days = per_day.select(*by, "date", running.alias("mau"), F.lead("date").over(order).alias("_next"), last.alias("_hi"))
    until = F.least(F.date_sub(F.coalesce("_next", F.date_add("_hi", 1)), 1), F.col("_hi"))
    return days.where(F.col("date") <= F.col("_hi")).select(*by, F.explode(F.sequence("date", until)).alias("date"), "mau")


def approx_monthly_active_users(events: DataFrame, user: str = "user_id", ts: str = "ts", window_days: int = 30,
                                by: Sequence[str] = (), lg_config_k: int = 12) -> DataFrame:
    """SRC-14, approximate: HLL sketches per day, unioned over the trailing
    ``window_days`` calendar days.

    One sketch per (group, day) is built with partial aggregation; the
    sliding union runs over one row per calendar day, so the work after the
    first aggregation does not depend on the number of users. Relative
    error is about 1.6% at the default ``lg_config_k=12``.
    """
    by = list(by)
    day = F.col(ts).cast("date")
    known = events.where(F.col(user).isNotNull())
    per_day = known.groupBy(*by, day.alias("date")).agg(F.hll_sketch_agg(user, lg_config_k).alias("_s"))
    span = per_day.groupBy(*by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    cal = span.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("date"))
    j = cal.join(per_day, [*by, "date"], "left")
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-(window_days - 1), 0)
    return j.select(*by, "date", F.hll_sketch_estimate(F.hll_union_agg("_s", True).over(w)).alias("mau_approx"))


def active_users_on(events: DataFrame, as_of, user: str = "user_id", ts: str = "ts", window_days: int = 30) -> Column:
    """SRC-14 scalar form: distinct users in the ``window_days`` before and
    including ``as_of``, as a scalar subquery column."""
    a = as_date_lit(as_of)
    day = F.col(ts).cast("date")
    f = events.where((day > F.date_sub(a, window_days)) & (day <= a))
    return f.agg(F.count_distinct(user).alias("mau")).select("mau").scalar()


DEFAULT_RANGES = [
    ("today", 0, 0),
    ("yesterday", 1, 1),
    ("last_7_days", 7, 1),
    ("last_30_days", 30, 1),
]

EVENTS_AS_OF = dt.date(2024, 1, 31)
