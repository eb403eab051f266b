"""Log shaping: e01-e21."""

from pyspark.sql import functions as F

from caseloom.operators import shape as S
from checks.base import l1, l2, l3, l4, l5, query, sql, table

KEEP = ["caseid", "task", "user", "start_ts", "end_ts", "pos"]

PAIR = """
with x as (select *, max(pos) over (partition by caseid) last_pos,
    first_value(case when transition='complete' then ts end ignore nulls)
      over (partition by caseid, task order by pos rows between 1 following and unbounded following) nxt from l4),
y as (select *, max(case when transition='start' and nxt is null and pos < last_pos then 1 else 0 end) over (partition by caseid) broken from x)
select caseid, task, "user", ts start_ts, nxt end_ts, pos from y where broken = 0 and transition='start' and nxt is not null"""


@query("e01_pairing", sql("l4", PAIR))
def _(spark, d):
    return S.pair_lifecycle(l4(spark, d))


@query("e01b_strict_pairing", sql("l4", """
with x as (select *, row_number() over (partition by caseid, task, transition order by pos) k from l4),
s as (select * from x where transition='start'), c as (select * from x where transition='complete'),
j as (select coalesce(s.caseid, c.caseid) caseid, coalesce(s.task, c.task) task, s."user" as "user", s.ts start_ts, c.ts end_ts, s.pos pos
      from s full join c on s.caseid=c.caseid and s.task=c.task and s.k=c.k)
select * from j where caseid not in (select caseid from j where start_ts is null or end_ts is null)"""))
def _(spark, d):
    return S.pair_strict(l4(spark, d))


@query("e01c_fifo_pairing", sql("l4", """
with x as (select *, row_number() over (partition by caseid, task, "user", transition order by pos) k from l4),
s as (select * from x where transition='start'), c as (select * from x where transition='complete')
select s.caseid, s.task, s."user", s.ts start_ts, c.ts end_ts, s.pos pos, c.pos end_pos, (epoch_us(c.ts)-epoch_us(s.ts))/1e6 proc
from s join c on s.caseid=c.caseid and s.task=c.task and s."user"=c."user" and s.k=c.k"""))
def _(spark, d):
    return S.pair_fifo(l4(spark, d))


@query("e02_completes", sql("l4", """select caseid, task, "user", ts start_ts, ts end_ts, pos from l4 where transition='complete'"""))
def _(spark, d):
    return S.completes_only(l4(spark, d))


@query("e03_to_lifecycle", sql("l2", """select caseid, task, "user", start_ts ts, 'start' transition, pos from l2
union all select caseid, task, "user", end_ts, 'complete', pos from l2"""))
def _(spark, d):
    return S.to_lifecycle(l2(spark, d))


AUG = """select caseid, task, "user", start_ts, end_ts, pos from l2
union all select caseid, 'Start', 'Start', min(start_ts) - interval 1 microsecond, min(start_ts) - interval 1 microsecond, min(pos)-1 from l2 group by caseid
union all select caseid, 'End', 'End', max(end_ts) + interval 1 microsecond, max(end_ts) + interval 1 microsecond, max(pos)+1 from l2 group by caseid"""


@query("e04_start_end", sql("l2", AUG))
def _(spark, d):
    return S.add_start_end(l2(spark, d)).select(*KEEP)


@query("e05_positions", sql("l2", """select *, row_number() over (partition by caseid order by start_ts, pos) pos_trace,
 count(*) over (partition by caseid) trace_len from l2"""))
def _(spark, d):
    return S.positions(l2(spark, d)).select(*KEEP, "pos_trace", "trace_len")


@query("e05_positions_ties", sql("l5", """select caseid, task, pos, row_number() over (partition by caseid order by start_ts, pos) pos_trace,
 count(*) over (partition by caseid) trace_len from l5"""))
def _(spark, d):
    return S.positions(l5(spark, d)).select("caseid", "task", "pos", "pos_trace", "trace_len")


@query("e06_traces", sql("l2", """select caseid, string_agg(task, '>' order by start_ts, pos) tasks,
 string_agg("user", '>' order by start_ts, pos) users from l2 group by caseid"""))
def _(spark, d):
    t = S.traces(l2(spark, d))
    return t.select("caseid", F.array_join("tasks", ">").alias("tasks"), F.array_join("users", ">").alias("users"))


@query("e06_traces_ties", sql("l5", "select caseid, string_agg(task, '>' order by end_ts, pos) tasks from l5 group by caseid"))
def _(spark, d):
    return S.traces(l5(spark, d), one_ts=True).select("caseid", F.array_join("tasks", ">").alias("tasks"))


DUR = """select *, epoch_us(end_ts)-epoch_us(start_ts) proc_us,
 greatest(coalesce(epoch_us(start_ts)-epoch_us(lag(end_ts) over (partition by caseid order by start_ts, pos)),0),0) wait_us from l2"""


@query("e07_durations", sql("l2", DUR))
def _(spark, d):
    return S.durations(l2(spark, d)).select(*KEEP, "proc_us", "wait_us")


ENABLE = """select *, coalesce(lag(end_ts) over (partition by caseid order by start_ts, pos), end_ts) enable_ts from l2"""


def _with_enable(log):
    from caseloom.functions.ordered import neighbours

    df = neighbours(log, ["caseid"], ["start_ts", "pos"], prev={"enable_ts": "end_ts"})
    return df.withColumn("enable_ts", F.coalesce("enable_ts", "end_ts"))


@query("e08_replay_metrics", sql("l2", f"""
with x as (select caseid, pos, epoch_us(start_ts)-epoch_us(enable_ts) gap, epoch_us(end_ts)-epoch_us(start_ts) d,
  epoch_us(end_ts)-epoch_us(enable_ts) after from ({ENABLE}) e)
select caseid, pos, case when gap >= 0 then gap else 0 end wait_us,
  case when gap < 0 and after > 0 then after else d end proc_us,
  case when gap >= 0 then 0 when after > 0 then -gap else d end multi_us, after duration_us from x"""))
def _(spark, d):
    return S.replay_metrics(_with_enable(l2(spark, d))).select("caseid", "pos", "wait_us", "proc_us", "multi_us", "duration_us")


@query("e09_scaling", sql("l2", f"""
with x as ({DUR}), m as (select *, max(proc_us) over (partition by task) mp, max(wait_us) over (partition by task) mw from x)
select caseid, pos, case when mp > 0 then round(proc_us/mp,9) else 0 end proc_norm, case when mw > 0 then round(wait_us/mw,9) else 0 end wait_norm from m"""))
def _(spark, d):
    df = S.scale_by_task(S.durations(l2(spark, d)), ["proc_us", "wait_us"])
    return df.select("caseid", "pos", F.round("proc_us_norm", 9).alias("proc_norm"), F.round("wait_us_norm", 9).alias("wait_norm"))


@query("e10_calendar", sql("l2", """select caseid, pos,
 hour(start_ts)*3600+minute(start_ts)*60+second(start_ts) st_daytime, isodow(start_ts)-1 st_weekday,
 hour(end_ts)*3600+minute(end_ts)*60+second(end_ts) end_daytime, isodow(end_ts)-1 end_weekday from l2"""))
def _(spark, d):
    return S.calendar_features(l2(spark, d)).select("caseid", "pos", "st_daytime", "st_weekday", "end_daytime", "end_weekday")


@query("e11_day_moment", sql("l2", """select caseid, pos, case when hour(start_ts) < 12 then 'morning'
 when hour(start_ts) < 17 then 'afternoon' else 'night' end day_moment from l2"""))
def _(spark, d):
    return S.day_moments(l2(spark, d)).select("caseid", "pos", "day_moment")


@query("e12_max_abs", sql("l2", f"""
with x as ({DUR}), m as (select max(abs(proc_us)) mp, max(abs(wait_us)) mw from x where cast(caseid as int) % 2 = 0)
select caseid, pos, round(proc_us/mp,9) proc_scaled, round(wait_us/mw,9) wait_scaled, round(round(proc_us/mp,9)*mp,0) proc_back
from x, m"""))
def _(spark, d):
    df = S.durations(l2(spark, d))
    cols = ["proc_us", "wait_us"]
    fit = S.fit_max_abs(df.filter(F.col("caseid").cast("int") % 2 == 0), cols)
    out = S.apply_max_abs(df, fit, cols)
    out = out.withColumns({c + "_scaled": F.round(c + "_scaled", 9) for c in cols})
    back = S.invert_max_abs(out, fit, cols)
    return back.select(
        "caseid", "pos", F.col("proc_us_scaled").alias("proc_scaled"), F.col("wait_us_scaled").alias("wait_scaled"), F.round("proc_us_back", 0).alias("proc_back")
    )


def _index_sql(col):
    return f"""
with x as (select coalesce({col}, 'sys') name, min(pos) p from l2 group by 1)
select name, row_number() over (order by p, name) id from x
union all select 'Start', 0 union all select 'End', (select count(*)+1 from x)"""


@query("e13_task_index", sql("l2", _index_sql("task")))
def _(spark, d):
    return S.category_index(l2(spark, d), "task")


@query("e13_user_index", sql("l2", _index_sql('"user"')))
def _(spark, d):
    return S.category_index(l2(spark, d), "user")


@query("e14_task_codes", sql("l7", "select task, dense_rank() over (order by task) code from (select distinct task from l7) x"))
def _(spark, d):
    return S.task_codes(l7_(spark, d))


@query("e15_next_task", sql("l2", """select caseid, pos, lead(task) over w next_task, lead("user") over w next_user
 from l2 window w as (partition by caseid order by start_ts, pos)"""))
def _(spark, d):
    return S.next_values(l2(spark, d), {"next_task": "task", "next_user": "user"}).select("caseid", "pos", "next_task", "next_user")


@query("e16_duration_bins", sql("l2", """
with x as (select caseid, pos, (epoch_us(end_ts)-epoch_us(start_ts))/1e6 dur from l2),
n as (select greatest(cast(floor((max(dur)-min(dur))/avg(dur)) as int),1) n from x),
ed as (select k, (with s as (select dur, row_number() over (order by dur)-1 r, count(*) over () c from x)
        select max(case when r = floor((c-1)*(k/nn)) then dur end) + (max(case when r = ceil((c-1)*(k/nn)) then dur end)-max(case when r = floor((c-1)*(k/nn)) then dur end))*(max((c-1)*(k/nn))-floor(max((c-1)*(k/nn)))) from s) edge
       from (select unnest(range(0, n+1)) k, cast(n as double) nn from n) kk),
du as (select distinct edge from ed)
select caseid, pos, dur, greatest((select count(*) from du where edge < dur) - 1, 0) bin from x"""))
def _(spark, d):
    return S.duration_bins(l2(spark, d)).select("caseid", "pos", "dur", "bin")


@query("e17_occurrence", sql("l2", """select caseid, pos, concat(task, cast(row_number() over (partition by caseid, task order by start_ts, pos)-1 as varchar)) label from l2"""))
def _(spark, d):
    return S.occurrence_labels(l2(spark, d)).select("caseid", "pos", "label")


@query("e18_case_profile", sql("l2", f"""
with x as ({DUR})
select caseid, string_agg(task,'>' order by start_ts,pos) profile, string_agg(cast(proc_us as varchar),'>' order by start_ts,pos) proc,
 string_agg(cast(wait_us as varchar),'>' order by start_ts,pos) wait, min(start_ts) start_time, max(start_ts) end_time from x group by caseid"""))
def _(spark, d):
    p = S.case_profiles(l2(spark, d))
    joined = [F.array_join(p[c].cast("array<string>"), ">").alias(c) for c in ("profile", "proc", "wait")]
    return p.select("caseid", *joined, "start_time", "end_time")


@query("e19_short_cases", sql("l2", f"""
with a as ({AUG}), b as (select * from a where cast(caseid as int) % 3 > 0 or task in ('Start','End'))
select caseid, count(*) n, min(start_ts) arrival from b group by caseid having count(*) filter (task not in ('Start','End')) = 0"""))
def _(spark, d):
    a = S.add_start_end(l2(spark, d)).filter((F.col("caseid").cast("int") % 3 > 0) | F.col("task").isin("Start", "End"))
    short = S.split_short_cases(a, short=True)
    return short.groupBy("caseid").agg(F.count("*").alias("n"), F.min("start_ts").alias("arrival"))


@query("e19_long_cases", sql("l2", f"""
with a as ({AUG}), b as (select * from a where cast(caseid as int) % 3 > 0 or task in ('Start','End'))
select caseid, task, pos from b where caseid in (select caseid from b where task not in ('Start','End'))"""))
def _(spark, d):
    a = S.add_start_end(l2(spark, d)).filter((F.col("caseid").cast("int") % 3 > 0) | F.col("task").isin("Start", "End"))
    return S.split_short_cases(a, short=False).select("caseid", "task", "pos")


@query("e20_tagged_union", sql("l2", """
select caseid, task, "user" resource, pos, 'log' source from l2 where cast(caseid as int) % 2 = 0
union all select concat('Case', caseid), task, "user", pos, 'simulation' from l2 where cast(caseid as int) % 2 = 1"""))
def _(spark, d):
    log = l2(spark, d)
    even = F.col("caseid").cast("int") % 2 == 0
    return S.tag_sources(log.filter(even), log.filter(~even)).select("caseid", "task", "resource", "pos", "source")


@query("e21_case_count", sql("l3", "select count(distinct caseid) cases, min(start_ts) first_start from l3"))
def _(spark, d):
    return S.case_count(l3(spark, d))


def l7_(spark, d):
    from checks.base import l7

    return l7(spark, d)
