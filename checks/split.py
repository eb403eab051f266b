"""Splits, sampling, thinning: p1-p8."""

from pyspark.sql import functions as F

from caseloom.operators import split as P
from checks.base import l2, l3, query, sql

CASES = "c as (select caseid, min(start_ts) t from {v} group by caseid), n as (select count(*) n from c), r as (select *, row_number() over (order by t, caseid) i from c, n)"


def _per_case(df):
    return df.groupBy("caseid", "split").agg(F.count("*").alias("events"))


@query("p1_timeline_contained", sql("l3", "with " + CASES.format(v="l3") + """
select l3.caseid, case when i <= floor(0.8::double*n) then 'train' else 'test' end split, count(*) events from l3 join r using (caseid) group by 1,2"""))
def _(spark, d):
    return _per_case(P.timeline_contained(l3(spark, d)))


@query("p2_timeline_trace", sql("l3", "with " + CASES.format(v="l3") + """
select l3.caseid, case when i <= n - round_even(n*(1-0.7::double),0) then 'train' else 'test' end split, count(*) events from l3 join r using (caseid) group by 1,2"""))
def _(spark, d):
    return _per_case(P.timeline_trace(l3(spark, d), 0.7))


@query("p3_random_split", None)
def _(spark, d):
    return _per_case(P.random_cases(l3(spark, d), 0.8, seed=7))


@query("p3_random_split_counts", sql("l3", """with n as (select count(distinct caseid) n from l3)
select floor(0.8*n) train_cases, n - floor(0.8*n) test_cases, (select count(*) from l3) events from n"""))
def _(spark, d):
    df = P.random_cases(l3(spark, d), 0.8, seed=7)
    per = df.groupBy("caseid", "split").agg(F.count("*").alias("n"))
    return per.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("train_cases"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_cases"),
        F.sum("n").alias("events"),
    )


@query("p4_fallback_split", sql("l2", "with " + CASES.format(v="l2") + """,
p1 as (select l2.caseid, case when i <= floor(0.95::double*n) then 'train' else 'test' end split, n from l2 join r using (caseid)),
p2 as (select l2.caseid, case when i <= n - round_even(n*(1-0.8::double),0) then 'train' else 'test' end split, n from l2 join r using (caseid)),
few as (select count(*) filter (split='test') < cast(floor(count(*)*0.1) as int) f from p1)
select caseid, split, count(*) events from (select * from p1 where not (select f from few) union all select * from p2 where (select f from few)) z group by 1,2"""))
def _(spark, d):
    return _per_case(P.contained_or_trace(l2(spark, d), 0.8, share=0.95))


@query("p5_sample", sql("l3", """with n as (select count(distinct caseid) n from l3)
select cast(ceil((1.96*1.96*0.25/0.0009)/(1+((1.96*1.96*0.25/0.0009)-1)/n)) as bigint) cases from n"""))
def _(spark, d):
    return P.sample_cases(l3(spark, d)).agg(F.countDistinct("caseid").alias("cases"))


@query("p5_sampled_log", None)
def _(spark, d):
    return P.sample_cases(l3(spark, d)).select("caseid", "task", "pos")


THIN = """
with c as (select caseid, min(start_ts) t from l2 group by caseid),
k as (select *, ntile(6) over (order by t, caseid)-1 chunk from c),
j as (select *, row_number() over (partition by chunk order by t, caseid)-1 j from k),
keep as (select * from j where chunk % 2 = 0 or j % 3 = 0)"""


@query("p6_thin_arrivals", sql("l2", THIN + " select caseid, task, pos from l2 where caseid in (select caseid from keep)"))
def _(spark, d):
    return P.thin_arrivals(l2(spark, d)).select("caseid", "task", "pos")


@query("p6_chunk_dates", sql("l2", THIN + " select chunk, min(t) start_date, max(t) end_date from j group by chunk"))
def _(spark, d):
    return P.chunk_dates(l2(spark, d))


@query("p7_shorten_waits", sql("l2", THIN + """
, w as (select l2.*, greatest(coalesce(epoch_us(start_ts)-epoch_us(lag(end_ts) over (partition by caseid order by start_ts, pos)),0),0) wait_us from l2)
select caseid, pos, chunk, wait_us, case when chunk % 2 = 1 then round(wait_us*(1-0.3::double),3) else wait_us end new_wait from w join keep using (caseid)"""))
def _(spark, d):
    return P.shorten_waits(l2(spark, d)).select("caseid", "pos", "chunk", "wait_us", F.round("new_wait", 3).alias("new_wait"))


@query("p8_hourly_arrivals", sql("l2", THIN + """
, h as (select 'original' source, date_trunc('hour', t) ds, count(*) y from c group by 2
  union all select 'modified', date_trunc('hour', t), count(*) from keep group by 2),
ax as (select source, unnest(generate_series(min(ds), max(ds), interval 1 hour)) ds from h group by source)
select ax.ds ds, coalesce(y,0) y, ax.source source from ax left join h on ax.ds=h.ds and ax.source=h.source"""))
def _(spark, d):
    log = l2(spark, d)
    return P.hourly_before_after(log, P.thin_arrivals(log))
