"""Registered queries: ledgers, sessions and episodes, experiments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave.operators import harness, ledger, sessions, stats

from .base import query


@query(
    "ledger_summary",
    "select actor, count(*) as entries, sum(coalesce(input_tokens, 0))::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(coalesce(cost, 0)), 4) as cost from ledger_rows group by rollup (actor)",
)
def ledger_summary(read):
    return ledger.summary(read("ledger_rows")).withColumn("cost", F.round("cost", 4))


@query("metrics_summary", "select count_if(op in ('toc', 'ask')) as consultations, count_if(op = 'ask') as searches, count(distinct page) as pages from ledger_rows")
def metrics_summary(read):
    return ledger.metrics_summary(read("ledger_rows").select("op", F.array("page").alias("pages")))


@query("recent_asks", "select id, page from ledger_rows where op = 'ask' order by ts desc, id desc limit 5")
def recent_asks(read):
    return ledger.recent(read("ledger_rows").where("op = 'ask'"), 5).select("id", "page")


_GROUPED = """select case when starts_with(action, 'reject') then 'rejected' else 'accepted' end as grp, field, value from
 (select action, 'derivable' as field, derivable as value from ledger_rows where op = 'adjudicate' union all select action, 'grounded', grounded from ledger_rows where op = 'adjudicate') where value is not null and action <> 'none'"""


@query(
    "triage_stats",
    f"""with g as ({_GROUPED}), r as (select *, row_number() over (partition by grp, field order by value) - 1 as pos, count(*) over (partition by grp, field) as n from g where not (grp = 'accepted' and field = 'grounded'))
    select grp as "group", field, max(n) as n, min(value) as min, max(case when pos = n // 2 then value end) as median, max(value) as max from r group by 1, 2""",
)
def triage_stats(read):
    return ledger.triage(read("ledger_rows"))


@query("triage_overlap", f"with g as ({_GROUPED}) select max(case when grp = 'accepted' then value end) >= min(case when grp = 'rejected' then value end) as overlap from g where field = 'derivable'")
def triage_overlap(read):
    return ledger.overlaps(ledger.triage(read("ledger_rows")))


@query("recent_window", "select id, action from ledger_rows where ts >= timestamp '2024-01-31 00:00:00' - interval 7 day")
def recent_window(read):
    return read("ledger_rows").where(ledger.within_days(F.col("ts"), "2024-01-31 00:00:00", 7)).select("id", "action")


@query("newest_rejections", "select id, action, page from ledger_rows where starts_with(action, 'reject') order by ts desc, id desc limit 20")
def newest_rejections(read):
    return ledger.recent(read("ledger_rows").where(F.col("action").startswith("reject")), 20).select("id", "action", "page")


@query(
    "remedies",
    """select id, case when derivable_kind and action = 'reject_derivable' then 'restate_as_framing' when action = 'reject_derivable' then 'leave_to_the_code' when action = 'reject_unsupported' then 'add_evidence' end as remedy
    from (select *, id % 3 = 0 and grounded >= 0.6 as derivable_kind from ledger_rows)""",
)
def remedies(read):
    kind = F.when(F.col("id") % 3 == 0, "decision").otherwise("fact")
    return read("ledger_rows").select("id", ledger.remedy(F.col("action"), kind, F.col("grounded")).alias("remedy"))


@query("claim_brief", "select count_if(action = 'file') as file, 0::bigint as file_user_stated, 0::bigint as reinforce, 0::bigint as review, count_if(starts_with(action, 'reject')) as rejected from ledger_rows")
def claim_brief(read):
    return ledger.brief(read("ledger_rows"))


# --- sessions ----------------------------------------------------------------------------------------------------

_EPISODES = """m as (select *, role = 'assistant' and coalesce(stop_reason, 'stop') not in ('toolUse', 'pending') as closing, coalesce(stop_reason, 'stop') as stop from messages where role in ('user', 'assistant')),
s as (select *, case when role = 'user' or coalesce(lag(closing) over w, true) then 1 else 0 end as starts, lead(role) over w as next_role, lead(ts) over w as next_ts from m window w as (partition by session order by ord)),
e as (select *, sum(starts) over (partition by session order by ord) as episode from s),
g as (select session, episode, min(ord) as first_ord, arg_min(ts, ord) as started, count_if(role = 'assistant') as n_requests, arg_min(role, ord) <> 'user' as implicit,
      arg_max(closing, ord) as closing, arg_max(stop, ord) as stop, arg_max({'v': next_role}, ord).v as next_role, arg_max(ts, ord) as last_ts, arg_max({'v': next_ts}, ord).v as next_ts from e group by 1, 2),
eps as (select session, episode::bigint as episode, first_ord, started, n_requests, implicit, case when closing then case when stop = 'stop' then 'settled' else 'interrupted' end when next_role = 'user' then 'steered' else 'eof' end as end_reason,
      case when closing then last_ts when next_role = 'user' then next_ts end as ended from g)"""


@query("episodes", f"with {_EPISODES} select * from eps")
def episodes(read):
    return sessions.episodes(read("messages"))


@query(
    "episode_labels",
    f"with {_EPISODES}, n as (select *, row_number() over (order by coalesce(started, ''), session, episode) as k from eps) select session, episode, 'E' || case when k < 10 then '0' else '' end || k::varchar as label from n",
)
def episode_labels(read):
    return sessions.labelled(sessions.episodes(read("messages"))).select("session", "episode", "label")


@query("episode_endings", f"with {_EPISODES} select end_reason, count(*) as n, sum(n_requests)::bigint as requests from eps group by end_reason")
def episode_endings(read):
    return sessions.episodes(read("messages")).groupBy("end_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_requests").alias("requests"))


@query("last_timestamps", "select session, max(ts) as last_ts from messages group by session")
def last_timestamps(read):
    return sessions.last_timestamps(read("messages"))


_SPANS = """spans as (select user_id::varchar as session, event_id as episode, ts as started, ts + interval 3 hour as ended from events where event_type = 'signup')"""


@query("event_attribution", f"with {_SPANS} select s.session, e.event_id, s.episode from events e join spans s on e.user_id::varchar = s.session and e.ts between s.started and s.ended where e.event_type <> 'signup'")
def event_attribution(read):
    events = read("events").withColumn("session", F.col("user_id").cast("string"))
    eps = events.where("event_type = 'signup'").select("session", F.col("event_id").alias("episode"), F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 3 hours")).alias("ended"))
    return sessions.attribute(events.where("event_type <> 'signup'").select("event_id", "session", "ts"), eps)


@query(
    "capture_gates",
    """with x as (select event_id, user_id, ts, event_id % 6 as messages, (event_id % 10) * 1e-1 as worth from events), l as (select *, lag(messages) over w as pm, lag(ts) over w as pt from x window w as (partition by user_id order by ts, event_id))
    select event_id, messages >= 3 and messages is distinct from pm and coalesce(floor(epoch(ts)) - floor(epoch(pt)), 1000000000) >= 600 and worth >= 0.6 as capture from l""",
)
def capture_gates(read):
    events = read("events").select("event_id", F.col("user_id").alias("session"), "ts", (F.col("event_id") % 6).alias("messages"), ((F.col("event_id") % 10) * 0.1).alias("worth"))
    return sessions.captures(events).select("event_id", "capture")


@query(
    "session_projects",
    "select lower(case when user_id % 2 = 0 then 'C:/Work' else 'c:/work' end || (user_id % 7)::varchar) as cwd, event_type as root, count(*) as sessions, min(ts) as first_ts, max(ts) as last_ts from events group by 1, 2",
)
def session_projects(read):
    cwd = F.concat(F.when(F.col("user_id") % 2 == 0, "C:/Work").otherwise("c:/work"), (F.col("user_id") % 7).cast("string"))
    return sessions.projects(read("events").select(cwd.alias("cwd"), F.col("event_type").alias("root"), "ts"))


_COMMANDS = ["git status && ls", "git commit -m x", "sudo npx tsc --noEmit", "npm run test", "pip install a", "FOO=1 rg needle src", "echo hi", "cargo test", "cd a && cat b | head", ""]
_BUCKETS = ["explore", "act", "verify", "verify", "other", "explore", "other", "verify", "explore", "other"]
_TOOLS = ["bash", "read", "edit", "wiki_ask", "wiki_insights", "unknown"]


def _pick(values: list[str], at):
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


@query(
    "tool_buckets",
    f"""with x as (select event_id as id, {_TOOLS!r}[event_id % 6 + 1] as tool, {_COMMANDS!r}[event_id // 6 % 10 + 1] as cmd, {_BUCKETS!r}[event_id // 6 % 10 + 1] as b from events)
    select id, case when tool in ('wiki_ask', 'wiki_insights') then 'wiki' when tool = 'read' then 'explore' when tool = 'edit' then 'act' when tool = 'bash' then b else 'other' end as bucket,
    case when tool = 'wiki_ask' then 'read' when tool = 'wiki_insights' then 'write' end as wiki_kind, tool = 'bash' and starts_with(cmd, 'FOO') as search from x""",
)
def tool_buckets(read):
    tool, cmd = _pick(_TOOLS, F.col("event_id") % 6), _pick(_COMMANDS, F.floor(F.col("event_id") / 6) % 10)
    rows = read("events").select(F.col("event_id").alias("id"), tool.alias("tool"), cmd.alias("cmd")).withColumn("bucket", sessions.classify(F.col("tool"), F.col("cmd"), F.lit(False)))
    return rows.select("id", "bucket", sessions.wiki_call_kind(F.col("tool")).alias("wiki_kind"), sessions.is_search(F.col("tool"), F.col("bucket"), F.col("cmd")).alias("search"))


@query(
    "call_results",
    """with r as (select user_id, event_id // 2 as call_id, arg_max(event_id % 97, event_id) as chars, arg_max(event_id % 11 = 0, event_id) as err from events where event_type <> 'view' group by 1, 2)
    select c.event_id as call_id, r.chars, coalesce(r.err, false) as is_error from events c left join r on c.user_id = r.user_id and c.event_id = r.call_id where c.event_type = 'view'""",
)
def call_results(read):
    events = read("events").withColumn("session", F.col("user_id").cast("string"))
    calls = events.where("event_type = 'view'").select("session", F.col("event_id").alias("call_id"))
    results = events.where("event_type <> 'view'").select("session", F.floor(F.col("event_id") / 2).alias("call_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 97).alias("chars"), (F.col("event_id") % 11 == 0).alias("is_error"))
    return sessions.results_of_calls(calls, results).select("call_id", "chars", "is_error")


@query(
    "nested_calls",
    """select c.conv_id::varchar as session, 'k' || (c.turn // 2)::varchar || '/' || c.turn::varchar as id, case when o.conv_id is not null then 'k' || (c.turn // 2)::varchar end as parent from conversations c
    left join (select distinct conv_id, turn from conversations where role = 'user') o on o.conv_id = c.conv_id and o.turn = c.turn // 2 where c.role = 'assistant'""",
)
def nested_calls(read):
    c = read("conversations").withColumn("session", F.col("conv_id").cast("string"))
    inner = c.where("role = 'assistant'").select("session", F.concat(F.lit("k"), F.floor(F.col("turn") / 2).cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"))
    outer = c.where("role = 'user'").select("session", F.concat(F.lit("k"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("ord"))
    return sessions.nested_calls(inner, outer)


@query(
    "active_branches",
    """with recursive t as (select conv_id::varchar as session, turn as ord, turn::varchar as id, case when turn = 0 then null when turn % 3 = 0 then (turn - 2)::varchar else (turn - 1)::varchar end as parent from conversations),
    w as (select session, ord, id, parent from (select *, row_number() over (partition by session order by ord desc) as r from t) where r = 1 union all select t.session, t.ord, t.id, t.parent from t join w on t.session = w.session and t.id = w.parent)
    select session, ord, id, false as broken from w""",
)
def active_branches(read):
    t = F.col("turn")
    parent = F.when(t == 0, None).when(t % 3 == 0, (t - 2).cast("string")).otherwise((t - 1).cast("string"))
    return sessions.active_branch(read("conversations").select(F.col("conv_id").cast("string").alias("session"), t.alias("ord"), t.cast("string").alias("id"), parent.alias("parent_id")))


@query(
    "project_totals",
    """with x as (select (event_id % 50) * 1e-2 as cost, event_id % 4 as wiki_reads, event_id % 3 = 0 as rediscovered from events)
    select count(*) as episodes, round(sum(cost), 6) as cost, count_if(wiki_reads > 0) as consulted, round(count_if(wiki_reads > 0) / count(*)::double, 6) as consultation_rate,
    round(count_if(wiki_reads > 0 and rediscovered) / count_if(wiki_reads > 0)::double, 6) as rediscovery_rate, round(median(cost), 6) as median_cost from x""",
)
def project_totals(read):
    e = F.col("event_id")
    return sessions.totals(read("events").select(((e % 50) * 0.01).alias("cost"), (e % 4).alias("wiki_reads"), (e % 3 == 0).alias("rediscovered")))


@query("same_query_suppressed", "with l as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select event_id from l where event_type is distinct from p")
def same_query_suppressed(read):
    earlier = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read("events").withColumn("p", earlier).where(~F.col("event_type").eqNullSafe(F.col("p"))).select("event_id")


# --- experiments -------------------------------------------------------------------------------------------------

_LATEST = "latest as (select * from (select *, row_number() over (partition by task, arm, repeat order by ordinal desc) as r from runs) where r = 1)"
_VALID = f"{_LATEST}, ok as (select * from latest where coalesce(valid, expected is not distinct from observed) and coalesce(clean, true) and cost is not null)"


@query("latest_runs", f"with {_LATEST} select task, arm, repeat, ordinal from latest")
def latest_runs(read):
    return stats.latest(read("runs")).select("task", "arm", "repeat", "ordinal")


def _valid(read):
    ok = stats.is_valid(*[F.col(c) for c in ("valid", "expected", "observed", "clean", "cost")])
    return stats.latest(read("runs")).where(ok)


@query("valid_runs", f"with {_VALID} select ordinal from ok")
def valid_runs(read):
    return _valid(read).select("ordinal")


@query("paired_runs", f"with {_VALID} select a.task, a.repeat, a.cost as treated, b.cost as control from ok a join ok b on a.task = b.task and a.repeat = b.repeat and a.arm = 'wiki' and b.arm = 'off' where a.cost > 0 and b.cost > 0")
def paired_runs(read):
    return stats.pairs(_valid(read), "wiki", "off")


@query(
    "paired_report",
    f"""with {_VALID}, p as (select ln(a.cost / b.cost) as r from ok a join ok b on a.task = b.task and a.repeat = b.repeat and a.arm = 'wiki' and b.arm = 'off' where a.cost > 0 and b.cost > 0), s as (select stddev_samp(r) as sd from p)
    select count(*) as n, round(avg(r), 6) as mean, round(median(r), 6) as median, round(any_value(sd), 6) as sd, {", ".join(f"ceil(8 * any_value(sd) ** 2 / ln(1 + {e}) ** 2)::bigint as pairs_for_{round(100 * e)}" for e in (0.1, 0.2, 0.3, 0.5))} from p, s""",
)
def paired_report(read):
    return stats.paired_report(stats.pairs(_valid(read), "wiki", "off"))


@query("arm_summary", f"with {_VALID} select arm, count(cost) as n, round(avg(cost), 6) as mean, round(stddev_samp(cost), 6) as sd, round(median(cost), 6) as median from ok group by arm")
def arm_summary(read):
    return stats.describe(_valid(read), "cost", "arm")


_BY_TASK = "t as (select task, arm, count(cost) as n, avg(cost) as m, min(cost) as low, max(cost) as high from ok group by 1, 2)"


@query("judge_rows", f"with {_VALID}, {_BY_TASK} select task, arm, n, round(m, 9) as mean, low, high from t")
def judge_rows(read):
    return stats.judged_by_task(_valid(read).withColumnRenamed("cost", "total")).withColumn("mean", F.round("mean", 9))


@query("judge_table", f"with {_VALID}, {_BY_TASK}, a as (select arm, count(cost) as n, round(avg(cost), 6) as mean from ok group by arm) select arm, a.n, a.mean, round(avg(high - low), 6) as within_task_range from t join a using (arm) group by 1, 2, 3")
def judge_table(read):
    rows = stats.judged_by_arm(stats.judged_by_task(_valid(read).withColumnRenamed("cost", "total")))
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("within_task_range", F.round("within_task_range", 6))


@query(
    "run_outcomes",
    f"""with {_VALID}, p as (select a.cost as ca, b.cost as cb, case when a.ordinal % 5 = 0 then null else a.ordinal % 3 > 0 end as pa, case when b.ordinal % 5 = 0 then null else b.ordinal % 3 > 0 end as pb
      from ok a join ok b on a.task = b.task and a.repeat = b.repeat and a.arm = 'wiki' and b.arm = 'off' where a.cost > 0 and b.cost > 0)
    select count(*) as pairs, count_if(pa) as treated_passed, count_if(pb) as control_passed, count_if(pa and not pb) as only_treated, count_if(pb and not pa) as only_control from p""",
)
def run_outcomes(read):
    passed = F.when(F.col("ordinal") % 5 != 0, F.col("ordinal") % 3 > 0)
    return stats.outcomes(_valid(read).withColumn("passed", passed), "wiki", "off")


@query("average_ranks", "select event_id, rank() over (partition by user_id order by event_id % 20) + (count(*) over (partition by user_id, event_id % 20) - 1) / 2.0::double as rank from events")
def average_ranks(read):
    rows = read("events").withColumn("v", F.col("event_id") % 20)
    return rows.select("event_id", stats.average_rank(F.col("v"), ["user_id"]).alias("rank"))


@query(
    "normal_p_values",
    """with x as (select event_id, abs(event_id % 400 * 1e-2 - 2) / sqrt(2) as x from events), t as (select *, 1 / (1 + 0.3275911::double * x) as t from x)
    select event_id, round(1 - (1 - ((((1.061405429::double * t - 1.453152027::double) * t + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-x * x)), 6) as p from t""",
)
def normal_p_values(read):
    return read("events").select("event_id", F.round(stats.normal_two_sided_p((F.col("event_id") % 400) * 0.01 - 2), 6).alias("p"))


_RANKS = """d as (select contrast, diff, abs(diff) as size from {source} where diff <> 0), r as (select *, rank() over (partition by contrast order by size) + (count(*) over (partition by contrast, size) - 1) / 2.0::double as rank from d),
w as (select contrast, count(*) as n, sum(case when diff > 0 then rank else 0 end) as plus, count(*) * (count(*) + 1) / 2.0::double as total from r group by contrast)"""

# more than fifteen pairs: the normal form, with corrections for ties and continuity
_NORMAL_SQL = f"""with {_VALID}, p as (select 'wiki-off' as contrast, a.cost - b.cost as diff from ok a join ok b on a.task = b.task and a.repeat = b.repeat and a.arm = 'wiki' and b.arm = 'off' where a.cost > 0 and b.cost > 0),
{_RANKS.format(source="p")},
ties as (select contrast, sum(t ** 3 - t) as c from (select contrast, size, count(*) as t from r group by 1, 2) group by 1),
z as (select *, abs(abs(plus - total / 2) - case when plus = total / 2 then 0 else 0.5 end) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - c / 48) / sqrt(2) as x from w join ties using (contrast)),
e as (select *, 1 / (1 + 0.3275911::double * x) as t from z)
select contrast, n, least(plus, total - plus) as statistic, round(((((1.061405429::double * t - 1.453152027::double) * t + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-x * x), 6) as p from e"""


@query("signed_ranks", _NORMAL_SQL)
def signed_ranks(read):
    rows = stats.paired_tests(stats.pairs(_valid(read), "wiki", "off").withColumn("contrast", F.lit("wiki-off")))
    return rows.select("contrast", "n", "statistic", F.round("p", 6).alias("p"))


# a few pairs of each task: all subsets of the ranks, one by one
_EXACT_SQL = f"""with recursive {_VALID}, p as (select a.task as contrast, round(a.cost) - round(b.cost) as diff from ok a join ok b on a.task = b.task and a.repeat = b.repeat and a.arm = 'wiki' and b.arm = 'off' where a.cost > 0 and b.cost > 0),
{_RANKS.format(source="p")},
o as (select contrast, rank, row_number() over (partition by contrast order by size, diff) as k from r),
s as (select contrast, 0 as k, 0::double as total from w union all select s.contrast, s.k + 1, s.total + case when c.take = 1 then o.rank else 0 end from s join o on o.contrast = s.contrast and o.k = s.k + 1, (values (0), (1)) c(take)),
x as (select s.contrast, count_if(abs(s.total - w.total / 2) >= abs(w.plus - w.total / 2) - 1e-9) / count(*)::double as p from s join w on w.contrast = s.contrast and s.k = w.n group by 1)
select a.contrast, coalesce(w.n, 0) as n, coalesce(least(plus, total - plus), 0) as statistic, round(coalesce(p, 1), 6) as p from (select distinct contrast from p) a left join w using (contrast) left join x using (contrast)"""


@query("signed_ranks_of_tasks", _EXACT_SQL)
def signed_ranks_of_tasks(read):
    paired = stats.pairs(_valid(read), "wiki", "off").withColumn("contrast", F.col("task")).withColumn("treated", F.round("treated")).withColumn("control", F.round("control"))
    return stats.paired_tests(paired).select("contrast", "n", "statistic", F.round("p", 6).alias("p"))


@query("paired_tests")
def paired_tests(read):
    return stats.paired_tests(stats.pairs(_valid(read), "wiki", "off").withColumn("contrast", F.lit("wiki-off")))


@query(
    "toolset_differences",
    """with t as (select user_id, list(event_type) filter (event_id % 3 = 0) || ['wiki_ask', 'read'] as a, list(case when event_id % 7 = 0 then 'wiki_' || event_type else event_type end) filter (event_id % 3 <> 0) || ['read'] as b from events group by user_id),
    x as (select user_id, list_sort(list_distinct(list_filter(coalesce(a, ['wiki_ask', 'read']), lambda v: not starts_with(v, 'wiki_')))) as a, list_sort(list_distinct(list_filter(coalesce(b, ['read']), lambda v: not starts_with(v, 'wiki_')))) as b, len(list_distinct(list_filter(coalesce(b, ['read']), lambda v: starts_with(v, 'wiki_')))) as w from t)
    select user_id, array_to_string(list_filter(a, lambda v: not list_contains(b, v)), ',') as only_off, array_to_string(list_filter(b, lambda v: not list_contains(a, v)), ',') as only_on, len(a)::int as shared, w::int as wiki_tools, list_sort(a) = list_sort(b) as comparable from x""",
)
def toolset_differences(read):
    third, kind = F.col("event_id") % 3 == 0, F.col("event_type")
    named = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("wiki_"), kind)).otherwise(kind)
    rows = read("events").groupBy("user_id").agg(F.concat(F.collect_list(F.when(third, kind)), F.array(F.lit("wiki_ask"), F.lit("read"))).alias("off"), F.concat(F.collect_list(F.when(~third, named)), F.array(F.lit("read"))).alias("on"))
    return harness.toolset_differences(rows).select("user_id", F.array_join("only_off", ",").alias("only_off"), F.array_join("only_on", ",").alias("only_on"), "shared", "wiki_tools", "comparable")
