"""Gate and refresh policy over probes made from the signals, in batch form and as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.plans import monitoring
from sigloom.registry.base import query, stamp, stream_query
from sigloom.registry.streams import drained, in_batches, micros
from sigloom.streaming.gate import GateRules, gated
from sigloom.streaming.refresh import RefreshPolicy

#: Feeds that are probed, and every how many signals a probe fails.
FEEDS, FAILS = 40, 23
#: Age that forces a refresh in the query, long enough for the signals to be rare at it.
FORCE_SECONDS = 6 * 3600
#: How long after the newest probe another one may come.
DELAY_MINUTES = 10

PROBES = (
    f"select 'feed' || (id % {FEEDS}) as feed, timestamp as probe_time, "
    f"case when id % {FAILS} <> 0 and score_week is not null "
    "then cast(floor((id + 9 * (id % 5)) / 5) as bigint) end as max_id, "
    f"case when id % {FAILS} <> 0 then date_trunc('hour', timestamp) end as max_timestamp, "
    f"case when id % {FAILS} = 0 then 'timeout' end as error, id from scoring_history"
)


def probe_history(facts: DataFrame) -> DataFrame:
    """A probe at every signal; newest id and time move now and then, some probes fail."""
    number, fails = F.col("id"), F.col("id") % FAILS == 0
    newest = F.floor((number + 9 * (number % 5)) / 5).cast("bigint")
    return facts.select(
        F.concat(F.lit("feed"), (number % FEEDS).cast("string")).alias("feed"),
        F.col("timestamp").alias("probe_time"),
        F.when(~fails & F.col("score_week").isNotNull(), newest).alias("max_id"),
        F.when(~fails, F.date_trunc("hour", "timestamp")).alias("max_timestamp"),
        F.when(fails, F.lit("timeout")).alias("error"),
        "id",
    )


# A walk over the probes of all feeds, one step to every feed's next probe.  What the last change and the last
# refresh left behind is the walk's state.
WALK = (
    "steps as (select *, row_number() over (partition by feed order by probe_time, max_timestamp "
    f"nulls first, max_id nulls first) as n from ({PROBES})), "
    "walk as (select feed, 0::bigint as n, 0::bigint as kept_id, null::timestamp as kept_time, "
    "null::timestamp as refreshed_at, null::timestamp as timed_from, false as changed, "
    "null::varchar as reason from (select distinct feed from steps) "
    "union all select feed, n, case when moved then max_id else kept_id end, "
    "case when moved then max_timestamp else kept_time end, "
    "case when moved or error is not null or timed is null or "
    f"epoch_us(probe_time) - epoch_us(timed) >= {FORCE_SECONDS}000000 then probe_time else timed end, "
    "refreshed_at, moved or error is not null, "
    "case when error is not null then 'error' when moved then 'change' when timed is null or "
    f"epoch_us(probe_time) - epoch_us(timed) >= {FORCE_SECONDS}000000 then 'age' end "
    "from (select s.*, w.kept_id, w.kept_time, w.refreshed_at, "
    "s.error is null and coalesce(s.max_id, 0) <> 0 and (s.max_id > w.kept_id or "
    "s.max_timestamp is distinct from w.kept_time) as moved, "
    # Where the timer has brought the last refresh by then.
    "w.refreshed_at + to_microseconds((greatest(epoch_us(s.probe_time) - epoch_us(w.refreshed_at) - 1, 0) "
    f"// {FORCE_SECONDS}000000) * {FORCE_SECONDS}000000) as timed "
    "from walk w join steps s on s.feed = w.feed and s.n = w.n + 1)), "
    "decided as (select s.*, w.changed, w.reason, w.refreshed_at, w.timed_from from walk w "
    "join steps s on s.feed = w.feed and s.n = w.n)"
)
_SHOWN = f"feed, {stamp('probe_time')} as probe_time, max_id, {stamp('max_timestamp')} as max_timestamp, error"


@query("T4_change_gate", f"with recursive {WALK} select {_SHOWN}, id, changed from decided")
def t4(t):
    return monitoring.gate_history(probe_history(t("scoring_history")), error="error")


@query(
    "T4_change_gate_id",
    f"select {_SHOWN}, id, error is not null or coalesce(max_id, 0) > coalesce(max(max_id) over "
    "(partition by feed order by probe_time, max_id nulls first rows between unbounded preceding "
    f"and 1 preceding), 0) as changed from ({PROBES})",
)
def t4_id(t):
    return monitoring.gate_history(probe_history(t("scoring_history")), by_time=False, error="error")


@stream_query(
    "T5_refresh_policy",
    f"with recursive {WALK}, "
    # The timer's refreshes between two probes, and those behind a feed's last one.
    "gaps as (select feed, timed_from as refreshed_at, epoch_us(probe_time) - 1 as until "
    "from decided union all select feed, arg_max(refreshed_at, n), "
    "(select epoch_us(date_trunc('millisecond', max(probe_time))) from steps) - "
    f"{DELAY_MINUTES} * 60000000 - 1000 from decided group by feed), "
    "timed as (select feed, refreshed_at + to_microseconds(k * "
    f"{FORCE_SECONDS}000000) as probe_time from gaps, unnest(range(1, greatest(until - "
    f"epoch_us(refreshed_at), 0) // {FORCE_SECONDS}000000 + 1)) as u(k) where refreshed_at is not null) "
    f"select {_SHOWN}, changed, reason is not null as refresh, reason from decided union all "
    f"select feed, {stamp('probe_time')}, null, null, null, false, true, 'timer' from timed",
)
def t5(spark, folder, t):
    probes = in_batches(
        probe_history(t("scoring_history")).withColumns(
            {c: F.col(c).cast("timestamp") for c in ("probe_time", "max_timestamp")}
        ),
        "probes",
        micros("probe_time"),
    )
    rules = GateRules(RefreshPolicy.poll_mode(query_interval=FORCE_SECONDS), timer=True)
    return drained(spark, gated(probes, rules, f"{DELAY_MINUTES} minutes"), "decisions")
