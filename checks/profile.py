"""Profiles, distributions, roles: g1-g15."""

from pyspark.sql import functions as F

from caseloom.functions.times import span_us
from caseloom.operators import profile as G
from caseloom.operators import shape as S
from checks.base import l2, l3, l7, query, sql


def _dur(log):
    return log.withColumn("dur", span_us("start_ts", "end_ts") / 1e6)


FIT = """
x as (select task, (epoch_us(end_ts)-epoch_us(start_ts))/1e6 v from {v}),
s as (select task, count(*) n, min(v) lo, max(v) hi, avg(v) a, var_pop(v) var, stddev_pop(v) sd,
   avg(case when v>0 then ln(v) end) la, var_pop(case when v>0 then ln(v) end) lv,
   quantile_cont(v,0.25) q25, quantile_cont(v,0.75) q75 from x group by task),
w as (select *, case when q75>q25 then least(2*(q75-q25)/cbrt(n), (hi-lo)/(log2(n)+1)) else (hi-lo)/(log2(n)+1) end wd from s where n >= 100 and hi > lo),
b as (select *, cast(ceil((hi-lo)/wd) as int) nb, (hi-lo)/cast(ceil((hi-lo)/wd) as int) st from w),
c as (select task, least(cast(floor((v-lo)/st) as int), nb-1) k, count(*) c from x join b using (task) group by 1,2),
g as (select b.*, k from b, lateral (select unnest(range(0, b.nb)) k) t),
h as (select g.*, lo+(g.k+0.5)*st xx, coalesce(c.c,0)/(n*st) ht, least(greatest(3*a-lo-hi,lo),hi) pk, a*a/var kk, var/a th
      from g left join c on c.task=g.task and c.k=g.k),
e as (select task,
  sum((ht-exp(-(xx-a)*(xx-a)/(2*var))/sqrt(2*pi()*var))**2) "NORMAL",
  sum((ht-exp(-(xx-lo)/(a-lo))/(a-lo))**2) "EXPONENTIAL",
  sum((ht-1/(hi-lo))**2) "UNIFORM",
  sum((ht-case when xx<pk then 2*(xx-lo)/((hi-lo)*(pk-lo)) when pk<hi then 2*(hi-xx)/((hi-lo)*(hi-pk)) else 2/(hi-lo) end)**2) "TRIANGULAR",
  sum((ht-case when lo>0 then exp(-(ln(xx)-la)*(ln(xx)-la)/(2*lv))/(xx*sqrt(2*pi()*lv)) end)**2) "LOGNORMAL",
  sum((ht-exp((kk-1)*ln(xx)-xx/th-kk*ln(th)-lgamma(kk)))**2) "GAMMA" from h group by task),
u as (unpivot e on "NORMAL","EXPONENTIAL","UNIFORM","TRIANGULAR","LOGNORMAL","GAMMA" into name dname value sse),
best as (select task, arg_min(dname, sse) best from u group by task),
mc as (select task, v, count(*) c from x group by 1,2),
md as (select task, v md from (select *, row_number() over (partition by task order by c desc, v) r from mc) z where r=1),
f as (select s.*, md, case when lo=hi then 'FIXED' when n<100 then 'EXPONENTIAL' else best end dname from s left join best using (task) join md using (task)),
fit as (select task, dname,
  case when dname='FIXED' then floor(lo) when dname in ('NORMAL','LOGNORMAL','GAMMA') then round(a,1) when dname='UNIFORM' then 3600.0 when dname='TRIANGULAR' then round(md,1) else 0.0 end mean,
  case when dname='FIXED' then 0.0 when dname='NORMAL' then round(sd,1) when dname in ('LOGNORMAL','GAMMA') then round(sd*sd,1) when dname='EXPONENTIAL' then round(a,1) else round(lo,1) end arg1,
  case when dname in ('UNIFORM','TRIANGULAR') then round(hi,1) else 0.0 end arg2 from f)"""


@query("g1_distribution_errors", sql("l2", "with " + FIT.format(v="l2") + " select task, dname, round(sse*1e9,4) sse from u where sse is not null"))
def _(spark, d):
    e = G.distribution_errors(_dur(l2(spark, d)), ["task"], "dur").filter("sse is not null")
    return e.select("task", "dname", F.round(F.col("sse") * 1e9, 4).alias("sse"))


@query("g2_distributions", sql("l7", "with " + FIT.format(v="l7") + " select * from fit"))
def _(spark, d):
    return G.fit_distributions(_dur(l7(spark, d)), ["task"], "dur")


@query("g3_default_distribution", sql("l7", """with t as (select distinct task from l7),
x as (select task, (epoch_us(end_ts)-epoch_us(start_ts))/1e6 v from l7 where task like 'click%')
select t.task, 'EXPONENTIAL' dname, round(coalesce(avg(v),0),2) arg1 from t left join x using (task) group by t.task"""))
def _(spark, d):
    log = l7(spark, d)
    return G.default_distribution(_dur(log.filter(F.col("task").startswith("click"))), log.select("task").distinct(), "dur")


@query("g4_activity_description", sql("l2", "with " + FIT.format(v="l2") + """,
p as (select *, row_number() over (partition by caseid order by start_ts,pos) r,
  case when hour(start_ts)<12 then 'morning' when hour(start_ts)<17 then 'afternoon' else 'night' end m from l2)
select p.task, (select string_agg(m,',' order by m) from (select distinct m from p q where q.task=p.task) z) moments,
 (select string_agg("user",',' order by "user") from (select distinct "user" from p q where q.task=p.task) z) users,
 round(avg(distinct r),6) mean_pos, round(any_value(s.a),6) mean_dur, round(any_value(s.sd),6) std_dur, any_value(fit.dname) dname
from p join s on s.task=p.task join fit on fit.task=p.task group by p.task"""))
def _(spark, d):
    a = G.activity_description(l2(spark, d))
    return a.select(
        "task",
        F.array_join("moments", ",").alias("moments"),
        F.array_join("users", ",").alias("users"),
        *[F.round(c, 6).alias(c) for c in ("mean_pos", "mean_dur", "std_dur")],
        "dname",
    )


# users connected by profile correlation above the threshold
ROLES = """
n as (select "user" u, task, count(*) c from {v} group by 1,2),
full_n as (select us.u, ts.task, coalesce(n.c,0) c from (select distinct u from n) us cross join (select distinct task from n) ts left join n on n.u=us.u and n.task=ts.task),
pr as (select a.u a, b.u b, (count(*)*sum(a.c*b.c)-sum(a.c)*sum(b.c))/nullif(sqrt((count(*)*sum(a.c*a.c)-sum(a.c)*sum(a.c))*(count(*)*sum(b.c*b.c)-sum(b.c)*sum(b.c))::double),0) r
  from full_n a join full_n b using (task) where a.u < b.u group by 1,2),
ed as (select a, b from pr where r > {t} union all select b, a from pr where r > {t}),
cc as (select distinct u, u v from n union select cc.u, ed.b from cc join ed on cc.v=ed.a),
rt as (select u, min(v) root from cc group by u),
sz as (select root, count(*) s, row_number() over (order by count(*) desc, root) k from rt group by root),
roles as (select u "user", concat('Role ', cast(k as varchar)) role from rt join sz using (root))"""
R2 = "with recursive " + ROLES.format(v="l2", t="0.85")
R7 = "with recursive " + ROLES.format(v="l7", t="0.1")


@query("g5_dominant_role", sql("l7", R7 + """, c as (select task, role, count(*) n from l7 join roles using ("user") group by 1,2)
select task, role, n from (select *, row_number() over (partition by task order by n desc, role) r from c) z where r=1"""))
def _(spark, d):
    log = l7(spark, d)
    return G.dominant_role(log, G.discover_roles(log, 0.1))


@query("g6_resource_pools", sql("l7", R7 + " select role, count(*) size from roles group by role union all select 'SYSTEM', 20"))
def _(spark, d):
    return G.resource_pools(G.discover_roles(l7(spark, d), 0.1))


@query("g7_user_task_profile", sql("l7", "with recursive " + ROLES.format(v="l7", t="0.7") + ' select u "user", task, c n from full_n'))
def _(spark, d):
    return G.user_task_profile(l7(spark, d))


@query("g8_profile_correlation", sql("l7", R7 + " select a user_a, b user_b, round(r,6) r from pr"))
def _(spark, d):
    return G.profile_correlation(l7(spark, d)).withColumn("r", F.round("r", 6))


@query("g9_roles", sql("l2", R2 + " select * from roles"))
def _(spark, d):
    return G.discover_roles(l2(spark, d), 0.85)


@query("g9_roles_fine_tasks", sql("l7", R7 + " select * from roles"))
def _(spark, d):
    return G.discover_roles(l7(spark, d), 0.1)


@query("g10_resource_candidates", sql("l2", 'select task, "user", count(*) n from l2 group by 1,2'))
def _(spark, d):
    return G.task_user_counts(l2(spark, d))


SETS = """with lb as (select *, concat(task, cast(row_number() over (partition by caseid, task order by start_ts, pos)-1 as varchar)) label from l3),
ws as (select caseid, "user" resource, string_agg(label, ',' order by pos) workset from lb group by 1,2)"""


@query("g11_work_sets", sql("l3", SETS + " select * from ws"))
def _(spark, d):
    w = G.work_sets(S.occurrence_labels(l3(spark, d)))
    return w.select("caseid", "resource", F.array_join("workset", ",").alias("workset"))


@query("g11_case_partitions", sql("l3", SETS + " select caseid, string_agg(workset, ';' order by workset) sets from ws group by caseid"))
def _(spark, d):
    p = G.case_partitions(G.work_sets(S.occurrence_labels(l3(spark, d))).withColumn("workset", F.array_join("workset", ",")))
    return p.select("caseid", F.array_join("sets", ";").alias("sets"))


@query("g12_resource_given_workset", sql("l3", SETS + """, c as (select workset, resource, count(*) n from ws group by 1,2)
select workset, resource, n, round(n/sum(n) over (partition by workset),10) prob from c"""))
def _(spark, d):
    p = G.resource_given_workset(G.work_sets(S.occurrence_labels(l3(spark, d))))
    return p.withColumn("workset", F.array_join("workset", ","))


@query("g13_calendar", sql("l2", """select caseid, pos, 'working' calendar from l2 where isodow(start_ts) <= 5 and hour(start_ts) >= 9 and hour(start_ts) < 17
union all select caseid, pos, 'always' from l2"""))
def _(spark, d):
    log = l2(spark, d)
    out = [G.in_calendar(log, "start_ts", p).select("caseid", "pos", F.lit(p).alias("calendar")) for p in ("working", "always")]
    return out[0].unionByName(out[1])


@query("g14_with_roles", sql("l2", R2 + ' select caseid, pos, "user", role from l2 left join roles using ("user")'))
def _(spark, d):
    log = l2(spark, d)
    return G.with_roles(log, G.discover_roles(log, 0.85)).select("caseid", "pos", "user", "role")


@query("g15_user_shares", sql("l2", 'select task, "user", count(*) n, round(count(*)/sum(count(*)) over (partition by task),9) share from l2 group by 1,2'))
def _(spark, d):
    return G.shares_per_task(l2(spark, d), "user").withColumn("share", F.round("share", 9))
