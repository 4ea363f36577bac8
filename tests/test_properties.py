"""Property tests: locale parse round trip, upsert idempotence."""
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from kpiforge import functions as fx
from kpiforge.operators import facts

CENTS = st.integers(min_value=-10**11, max_value=10**11)


def _formats(cents: int) -> list[str]:
    v = cents / 100
    en = f"{v:,.2f}"
    return [en, en.replace(",", "_").replace(".", ",").replace("_", "."), f"{v:.2f}".replace(".", ","), f"{v:.2f}"]


@settings(max_examples=5, deadline=None)
@given(st.lists(CENTS, min_size=1, max_size=60))
def test_parse_number_round_trip(spark, values):
    rows_ = [(i, c, s) for i, c in enumerate(values) for s in _formats(c)]
    df = spark.createDataFrame(rows_, "i int, cents long, s string")
    out = df.select("cents", "s", fx.parse_number("s").alias("v")).collect()
    for r in out:
        # "1.234" style text (one group, no decimals) is a decimal number by rule; all our formats carry decimals
        assert r.v == r.cents / 100, (r.s, r.v)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 50)), min_size=1, max_size=20),
       st.lists(st.tuples(st.integers(0, 9), st.one_of(st.none(), st.integers(0, 50))), min_size=1, max_size=10))
def test_upsert_idempotent(spark, existing_rows, update_rows):
    d0 = dt.date(2026, 1, 1)
    ex = spark.createDataFrame([(d0 + dt.timedelta(days=k), v, i) for i, (k, v) in enumerate(existing_rows)],
                               "date date, ga_visitors long, seq long")
    up = spark.createDataFrame([(d0 + dt.timedelta(days=k), v, 100 + i) for i, (k, v) in enumerate(update_rows)],
                               "date date, ga_visitors long, seq long")
    once = facts.upsert(ex, up, ["date"])
    twice = facts.upsert(once, up, ["date"])
    a, b = sorted(tuple(r) for r in once.collect()), sorted(tuple(r) for r in twice.collect())
    assert a == b
    keys = {d0 + dt.timedelta(days=k) for k, _ in update_rows}
    assert sorted(r[0] for r in a if r[0] in keys) == sorted(keys)     # one row per updated key
