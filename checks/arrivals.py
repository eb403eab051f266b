"""Arrivals: a1-a8."""

from pyspark.sql import functions as F

from caseloom.operators import arrivals as A
from checks.base import l1, l2, l3, query, sql

ARR2 = "with a as (select caseid, min(start_ts) ts from l2 group by caseid)"
ARR3 = "with a as (select caseid, min(start_ts) ts from l3 group by caseid)"


@query("a1_gaps_per_day", sql("l3", """with a as (select caseid, min(start_ts) ts from l3 where task in ('click','view') group by caseid),
g as (select caseid, cast(ts as date) date, (epoch_us(ts)-epoch_us(lag(ts) over (partition by cast(ts as date) order by ts, caseid)))/1e6 inter_time from a)
select * from g where inter_time is not null"""))
def _(spark, d):
    return A.gaps_per_day(A.case_arrivals(l3(spark, d), ["click", "view"]))


@query("a1_gaps_per_day_one_ts", sql("l1", """with a as (select caseid, min(end_ts) ts from l1 group by caseid),
g as (select caseid, cast(ts as date) date, (epoch_us(ts)-epoch_us(lag(ts) over (partition by cast(ts as date) order by ts, caseid)))/1e6 inter_time from a)
select * from g where inter_time is not null"""))
def _(spark, d):
    return A.gaps_per_day(A.case_arrivals(l1(spark, d), one_ts=True))


@query("a2_gaps_global", sql("l3", ARR3 + """
select caseid, coalesce((epoch_us(ts)-epoch_us(lag(ts) over (order by ts, caseid)))/1e6, 0) inter_time, ts "timestamp",
 hour(ts)*3600+minute(ts)*60+second(ts) daytime, isodow(ts)-1 weekday from a"""))
def _(spark, d):
    return A.gaps_global(A.case_arrivals(l3(spark, d)))


DENSE = """, h as (select date_trunc('hour', ts) ds, count(*) y from a group by 1),
ax as (select unnest(generate_series(min(ds), max(ds), interval 1 hour)) ds from h),
dense as (select ax.ds ds, coalesce(y,0) y from ax left join h on ax.ds=h.ds)"""


@query("a3_hourly_series", sql("l3", ARR3 + DENSE + " select ds, y, round((select max(y)*1.2::double from h),6) cap, 0.0::double floor from dense"))
def _(spark, d):
    return A.hourly_series(A.case_arrivals(l3(spark, d))).withColumn("cap", F.round("cap", 6))


@query("a4_renumber", sql("l3", ARR3 + """ select concat('Case', cast(row_number() over (order by ts, caseid) as varchar)) caseid, ts "timestamp" from a"""))
def _(spark, d):
    return A.renumber(A.case_arrivals(l3(spark, d)))


GAPS = """, x as (select w, caseid, ts, cast(floor(hour(ts)/w) as int)+1 win, cast(ts as date) date, isodow(ts)-1 weekday
  from a, (select unnest([1,2,4,8,12]) w) ww),
g as (select w, win, date, weekday, caseid,
  (epoch_us(ts)-epoch_us(coalesce(lag(ts) over (partition by w, win, date order by ts, caseid), date_trunc('hour', ts))))/1e6 inter_time from x)"""


@query("a5_window_gaps", sql("l3", ARR3 + GAPS + ' select w, win "window", date, weekday, caseid, inter_time from g'))
def _(spark, d):
    return A.window_gaps(A.case_arrivals(l3(spark, d)))


@query("a6_window_stats", sql("l3", ARR3 + GAPS + """
, q as (select w, win, weekday, quantile_cont(inter_time, 0.15) a, quantile_cont(inter_time, 0.85) b, count(*) n, avg(inter_time) m, var_pop(inter_time) v from g group by all),
t as (select w, win, weekday, count(*) n, avg(inter_time) mt, stddev_pop(inter_time) st, min(inter_time) mi, max(inter_time) ma
  from g join q using (w, win, weekday) where q.n <= 2 or inter_time between a-1e-9 and b+1e-9 group by all),
c as (select w, win, weekday, date, count(*) c from g group by all),
cq as (select w, win, weekday, quantile_cont(c, 0.15) a, quantile_cont(c, 0.85) b, count(*) n from c group by all),
nm as (select w, win, weekday, cast(ceil(quantile_cont(c, 0.5)/2) as int) num from c join cq using (w, win, weekday) where n <= 2 or c between a-1e-9 and b+1e-9 group by all)
select w, win "window", weekday, t.n n, round(mt,2) mean_trim, round(st,2) std_trim, mi min_trim, ma max_trim, num, round(m,2) mean, round(v,2) var
from t join nm using (w, win, weekday) join q using (w, win, weekday)"""))
def _(spark, d):
    s = A.window_stats(A.window_gaps(A.case_arrivals(l3(spark, d))))
    r2 = {c: F.round(c, 2) for c in ("mean_trim", "std_trim", "mean")}
    return s.withColumns(r2).withColumn("var", F.round("var", 2))


@query("a7_moving_count", sql("l3", ARR3 + """
select caseid, ts, count(*) over (order by epoch_us(ts) range between 10799999999 preceding and current row) arrivals from a"""))
def _(spark, d):
    return A.moving_count(A.case_arrivals(l3(spark, d)))


@query("a8_rate_table", sql("l3", ARR3 + DENSE + """, cap as (select max(y)*1.2::double cap from dense)
select isodow(ds)-1 weekday, hour(ds) "hour", round(greatest(least(avg(y), max(cap)),0),6) expected,
 round(greatest(least(quantile_cont(y,0.1), max(cap)),0),6) low, round(greatest(least(quantile_cont(y,0.9), max(cap)),0),6) high
from dense, cap group by 1,2"""))
def _(spark, d):
    t = A.rate_table(A.dense_hours(A.case_arrivals(l3(spark, d))))
    return t.withColumns({c: F.round(c, 6) for c in ("expected", "low", "high")})
