"""kpiforge: KPI operators over Spark DataFrames.

Landed API documents, CRM records and event tables become daily fact
tables; those are kept correct with keyed upserts, gap-only backfills and
snapshot replacement, rolled up per month and served as deltas, lead
funnels, year-to-date scoreboards and long-form report datasets.

Every operator takes column names and optional grouping keys ``by`` so the
same logic runs for one small table or for many tenants at once.
"""

__version__ = "0.1.0"

from .operators.facts import (backfill, merge_sources, read_snapshot, upsert, upsert_table,  # noqa: E402,F401
                              write_snapshot)
from .operators.leads import lead_funnel, lead_lists, newest_leads, status_counts, won_stage_counts  # noqa: E402,F401
from .operators.reports import kpi_cards, series_long, table_counts  # noqa: E402,F401
from .operators.rollup import monthly_rollup, monthly_rollup_variant  # noqa: E402,F401
from .operators.targets import month_vs_target, progress_records, target_scoreboard, ytd_values  # noqa: E402,F401
from .operators.windows import (last_known_delta, offset_delta, period_sum_delta, trailing_range,  # noqa: E402,F401
                                trailing_sum_series)
from .session import get_session  # noqa: E402,F401
from .sources.events import (approx_monthly_active_users, daily_metrics, monthly_active_users,  # noqa: E402,F401
                             range_metrics)
from .sources.tables import load_daily, load_leads, load_monthly, load_targets  # noqa: E402,F401
