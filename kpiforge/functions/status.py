"""Classification expressions (FLT-8, SCL-20..23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LOST_STAGES, NEW_LEAD_DAYS, WAITING_STAGES, WON_STAGES
from .dates import as_of_date


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lead_status(stage, created, as_of, new_days: int = NEW_LEAD_DAYS,
                won=WON_STAGES, lost=LOST_STAGES, waiting=WAITING_STAGES) -> Column:
    """FLT-8: status-first classification.

    won > lost > waiting > created within ``new_days`` of ``as_of`` (new) >
    active. A NULL created date classifies as active (the reference drops the
    whole list instead).
    """
    s, c = _c(stage), _c(created)
    cutoff = F.date_sub(as_of_date(as_of), new_days)
    return (F.when(s.isin(*won), F.lit("won"))
            .when(s.isin(*lost), F.lit("lost"))
            .when(s.isin(*waiting), F.lit("waiting"))
            .when(c >= cutoff, F.lit("new"))
            .otherwise(F.lit("active")))


def on_track_status(ytd, target, progress) -> Column:
    """SCL-20: on_track when ytd >= target*progress, slightly_behind when
    >= 0.7 of that, else behind. A NULL target is behind (never NaN)."""
    due = _c(target).cast("double") * _c(progress)
    y = _c(ytd).cast("double")
    return (F.when(y >= due, F.lit("on_track"))
            .when(y >= due * F.lit(0.7), F.lit("slightly_behind"))
            .otherwise(F.lit("behind")))


def attainment_pct(value, target) -> Column:
    """Percent of target; 0 when the target is not positive."""
    t = _c(target).cast("double")
    return F.when(t > 0, _c(value).cast("double") / t * 100).otherwise(F.lit(0.0))


def attainment_band(pct) -> Column:
    """SCL-21: success >= 100, warning >= 70, else danger."""
    p = _c(pct)
    return (F.when(p >= 100, F.lit("success"))
            .when(p >= 70, F.lit("warning"))
            .otherwise(F.lit("danger")))


def gauge_edges(target) -> list[Column]:
    """SCL-21: gauge range edges at 0.7, 1.0 and 1.2 of the target."""
    t = _c(target).cast("double")
    return [(t * F.lit(0.7)).alias("edge_warning"), t.alias("edge_success"), (t * F.lit(1.2)).alias("edge_max")]


def progress_record(value, target, cap: float = 120.0) -> Column:
    """SCL-22: struct(value, target, percentage capped at ``cap``, band)."""
    pct = F.least(attainment_pct(value, target), F.lit(cap))
    return F.struct(_c(value).cast("double").alias("value"), _c(target).cast("double").alias("target"),
                    pct.alias("percentage"), attainment_band(pct).alias("band"))


def month_share(target_yearly) -> Column:
    """SCL-23: one twelfth of a yearly target."""
    return _c(target_yearly).cast("double") / 12
