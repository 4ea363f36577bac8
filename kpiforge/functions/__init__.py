"""Column expressions (SCL-*): all JVM-side, usable in any select/agg."""

from .dates import (as_date_lit, date_of_ms, day_end_ms, day_start_ms, days_before, days_in_year, in_year,
                    iso_date_prefix, month_key, utc_instant, weekend_factor, year_progress, yyyymmdd_to_date)
from .nested import (PAGE_RESPONSE_SCHEMA, PAGE_TYPE, PROPERTY_TYPE, first_present, prop_ids,
                     prop_number, prop_text)
from .numbers import (bounce_with_fallback, clamp, coerce_number, exact_sum, kwh_to_gwh, normalize_number_text, parse_number,
                      pct_change, round_half_even, round_half_up)
from .status import (attainment_band, attainment_pct, gauge_edges, lead_status, month_share,
                     on_track_status, progress_record)
from .text import clean_key, full_name, name_of

__all__ = [n for n in dir() if not n.startswith("_")]
