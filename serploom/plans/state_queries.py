"""Registered queries over what the attempt log shows, with SQL twins."""

from __future__ import annotations

from serploom.operators import states
from serploom.plans.views import sql, view

QUERIES = {}
ORACLE = {}

CODE_SQL = """case when ok then 1 when not reached_network or not charged or coalesce(category in ('cancelled', 'circuit_open'), false) then 0
    when category in ('rate_limited', 'timeout', 'network', 'server_error') then 2 else 3 end"""


def failure_streaks(spark, sf_dir):
    return states.failure_streaks(view(spark, sf_dir, "attempts"))


QUERIES["failure_streaks"] = failure_streaks
ORACLE["failure_streaks"] = sql(
    f"""select provider, cast(island as bigint) as island, count(*) as failures, min(event_id) as first_event, min(us) as started_us, max(us) as ended_us
    from (select provider, event_id, epoch_us(ts) as us, {CODE_SQL} as code,
            sum(case when ok then 1 else 0 end) over (partition by provider order by ts, event_id rows unbounded preceding) as island from attempts)
    where code = 2 group by provider, island""",
    "attempts",
)

OBSERVED_SQL = """select provider, case when category = 'circuit_open' then 'open' when coalesce(opened, -1) > coalesce(succeeded, -1) then 'half_open' else 'closed' end as circuit_state,
      coalesce(tried = 'rate_limited', false) as rate_limited
    from (select provider, arg_max_null(category, n) as category, max(n) filter (where category = 'circuit_open') as opened, max(n) filter (where ok) as succeeded,
            arg_max_null(category, n) filter (where coalesce(category, '') <> 'circuit_open') as tried
          from (select *, row_number() over (partition by provider order by ts, event_id) as n from attempts) group by provider)"""


def observed_states(spark, sf_dir):
    return states.observed_states(view(spark, sf_dir, "attempts"))


QUERIES["observed_states"] = observed_states
ORACLE["observed_states"] = sql(OBSERVED_SQL, "attempts")
