"""Process graph and conformance: s6, s7, c1-c15, g16; work in progress: w1-w6."""

from pyspark.sql import functions as F

from caseloom.operators import conform as C
from caseloom.operators import flow as W
from caseloom.operators import graph as GR
from caseloom.operators import profile as G
from caseloom.operators import shape as S
from caseloom.operators import wip as X
from checks.base import l2, l4, l8, query, sql
from checks.flow import DFG
from checks.profile import FIT, R2, ROLES
from checks.shape import AUG

AUG8 = """au as (select caseid, task, start_ts, pos from l8
 union all select caseid, 'Start', min(start_ts) - interval 1 microsecond, min(pos)-1 from l8 group by caseid
 union all select caseid, 'End', max(end_ts) + interval 1 microsecond, max(pos)+1 from l8 group by caseid)"""
GRAPH = AUG8 + ", " + DFG.format(v="au") + """,
k as (select d.a, d.b, d.n, coalesce(r.n,0) back from d left join d r on d.a=r.b and d.b=r.a),
f as (select a, b, n from k where a=b or back=0 or not abs(n-back)/(n+back) < 0.3),
g as (select a, b, n from (select *, row_number() over (partition by a order by n desc, b) ro, row_number() over (partition by b order by n desc, a) ri from f) z
  where n >= (select quantile_cont(n, 0.4) from f) or ro=1 or ri=1),
nm as (select a nm from g union select b from g),
dg as (select nm, (select count(*) from g where a=nm) outs, (select count(*) from g where b=nm) ins from nm),
pt as (select g.a, g.b, x.outs > 1 sp, y.ins > 1 jn from g join dg x on x.nm=g.a join dg y on y.nm=g.b),
nodes as (select concat('task:',nm) node_id, case when nm='Start' then 'start' when nm='End' then 'end' else 'task' end "type", nm "name" from dg
  union all select concat('split:',nm), 'gate', nm from dg where outs>1 union all select concat('join:',nm), 'gate2', nm from dg where ins>1),
edges as (select concat('task:',nm) src, concat('split:',nm) dst from dg where outs>1
  union all select concat('join:',nm), concat('task:',nm) from dg where ins>1
  union all select concat(case when sp then 'split:' else 'task:' end, a), concat(case when jn then 'join:' else 'task:' end, b) from pt)"""


def dfg8(spark, d):
    return W.filtered_graph(W.directly_follows(S.add_start_end(l8(spark, d))))


def graph8(spark, d):
    return GR.graph_of(dfg8(spark, d))


@query("s6_graph_nodes", sql("l8", "with " + GRAPH + ' select node_id, "type", "name" from nodes'))
def _(spark, d):
    return graph8(spark, d)[0].select("node_id", "type", "name")


@query("s6_graph_edges", sql("l8", "with " + GRAPH + " select src, dst from edges"))
def _(spark, d):
    return graph8(spark, d)[1].select("src", "dst")


@query("s7_flow_lookup", sql("l8", "with " + GRAPH + """ select e.src, e.dst, concat('flow:', e.src, '>', e.dst) flow_id from edges e
 where e.src like 'split:%'"""))
def _(spark, d):
    nodes, edges = graph8(spark, d)
    pairs = GR.gateway_branches(nodes, edges).select(F.col("gate").alias("src"), F.col("t_path").alias("dst")).distinct()
    return GR.find_flow(pairs, edges)


@query("c1_next_tasks", sql("l8", "with " + GRAPH + """ select a, b, array_to_string(list_concat(list_concat([concat('task:',a)], case when sp then [concat('split:',a)] else [] end),
 list_concat(case when jn then [concat('join:',b)] else [] end, [concat('task:',b)])),',') path from pt"""))
def _(spark, d):
    return GR.next_tasks(*graph8(spark, d)).withColumn("path", F.array_join("path", ","))


@query("c2_entry_tasks", sql("l8", "with " + GRAPH + " select b task, 'entry' kind from g where a='Start' union all select a, 'exit' from g where b='End'"))
def _(spark, d):
    g = graph8(spark, d)
    return GR.entry_tasks(*g).withColumn("kind", F.lit("entry")).unionByName(GR.exit_tasks(*g).withColumn("kind", F.lit("exit")))


@query("c3_gate_degree", sql("l8", "with " + GRAPH + """ select node_id, "type", count(*) num_paths from nodes join edges on src=node_id where "type" like 'gate%' group by 1,2"""))
def _(spark, d):
    return GR.out_degrees(*graph8(spark, d), types=["gate", "gate2", "gate3"])


CONF = GRAPH + """,
ok as (select a, b, sp, jn from pt where a<>b or (sp and jn)),
pr as (select caseid, a, b from (select caseid, task a, lead(task) over (partition by caseid order by start_ts, pos) b from au) z where b is not null),
cf as (select caseid, bool_and(exists (select 1 from ok where ok.a=pr.a and ok.b=pr.b)) conformant from pr group by caseid)"""


@query("c4_conformance", sql("l8", "with " + CONF + " select * from cf"))
def _(spark, d):
    return C.conformance(l8(spark, d), GR.next_tasks(*graph8(spark, d)))


@query("c5_enabling_time", sql("l8", "with " + GRAPH + """,
o as (select *, row_number() over (partition by caseid order by start_ts, pos) r from l8)
select e.caseid, e.pos, e.task, coalesce(arg_max(p.end_ts, p.r), any_value(e.end_ts)) enable_ts
from o e left join (o p join g on g.a=p.task) on p.caseid=e.caseid and p.r<e.r and g.b=e.task group by 1,2,3"""))
def _(spark, d):
    return C.enabling_times(l8(spark, d), GR.next_tasks(*graph8(spark, d))).select("caseid", "pos", "task", "enable_ts")


@query("c5_replay_times", sql("l8", "with " + GRAPH + """,
o as (select *, row_number() over (partition by caseid order by start_ts, pos) r from l8),
en as (select e.caseid, e.pos, e.task, any_value(e.start_ts) s, any_value(e.end_ts) e, coalesce(arg_max(p.end_ts, p.r), any_value(e.end_ts)) n
  from o e left join (o p join g on g.a=p.task) on p.caseid=e.caseid and p.r<e.r and g.b=e.task group by 1,2,3),
x as (select caseid, pos, task, epoch_us(s)-epoch_us(n) gap, epoch_us(e)-epoch_us(s) d, epoch_us(e)-epoch_us(n) aft from en)
select caseid, pos, task, case when gap >= 0 then gap else 0 end wait_us, case when gap < 0 and aft > 0 then aft else d end proc_us,
  case when gap >= 0 then 0 when aft > 0 then -gap else d end multi_us from x"""))
def _(spark, d):
    log = C.enabling_times(l8(spark, d), GR.next_tasks(*graph8(spark, d)))
    return S.replay_metrics(log).select("caseid", "pos", "task", "wait_us", "proc_us", "multi_us")


EXEC = CONF + """,
pc as (select pr.a, pr.b, ok.sp, ok.jn, count(*) n from pr join cf using (caseid) join ok on ok.a=pr.a and ok.b=pr.b where conformant group by 1,2,3,4),
us as (select concat('task:',a) src, concat('split:',a) dst, n from pc where sp union all select concat('join:',b), concat('task:',b), n from pc where jn
  union all select concat(case when sp then 'split:' else 'task:' end, a), concat(case when jn then 'join:' else 'task:' end, b), n from pc),
ex as (select src, dst, coalesce(sum(n),0)::bigint executions from edges left join us using (src, dst) group by 1,2)"""


@query("c6_edge_executions", sql("l8", "with " + EXEC + " select * from ex"))
def _(spark, d):
    g = graph8(spark, d)
    return C.edge_executions(l8(spark, d), GR.next_tasks(*g), g[1])


@query("c7_conformance_stats", sql("l8", "with " + CONF + " select count(*) traces, round(100*avg(conformant::int),4) pct_conformant, (select count(*) from l8) events from cf"))
def _(spark, d):
    log = l8(spark, d)
    return C.conformance_stats(log, C.conformance(log, GR.next_tasks(*graph8(spark, d))))


BR = "gp as (select concat('split:', a) gate, concat(case when jn then 'join:' else 'task:' end, b) t_path, concat('task:', b) t_task from pt where sp)"


@query("c8_gateway_branches", sql("l8", "with " + GRAPH + ", " + BR + " select * from gp"))
def _(spark, d):
    return GR.gateway_branches(*graph8(spark, d))


PROB = EXEC + ", " + BR + """, bp as (select gate, t_path, executions, coalesce(round(executions / nullif(sum(executions) over (partition by gate),0), 3),0) prob
 from gp join ex on src=gate and dst=t_path)"""


def _probs(spark, d):
    g = graph8(spark, d)
    ex = C.edge_executions(l8(spark, d), GR.next_tasks(*g), g[1])
    return GR.branch_probabilities(GR.gateway_branches(*g), ex)


@query("c9_branch_prob", sql("l8", "with " + PROB + " select * from bp"))
def _(spark, d):
    return _probs(spark, d)


@query("c10_branch_equal", sql("l8", "with " + GRAPH + ", " + BR + " select gate, t_path, round(1/count(*) over (partition by gate),2) prob from gp"))
def _(spark, d):
    return GR.equal_probabilities(GR.gateway_branches(*graph8(spark, d)))


@query("c11_branch_random", None)
def _(spark, d):
    return GR.random_probabilities(GR.gateway_branches(*graph8(spark, d)), seed=3)


@query("c12_repaired_prob", sql("l8", "with " + PROB + """,
q as (select *, round(round(1-sum(prob) over w,9),2) df, row_number() over (partition by gate order by prob, t_path) lo, row_number() over (partition by gate order by prob desc, t_path) hi, count(*) over w k
  from bp window w as (partition by gate)),
q2 as (select *, round(case when case when df>0 then lo=1 else hi=1 end then prob+df else prob end,10) p from q),
q3 as (select *, max((p=0)::int) over (partition by gate) z from q2)
select gate, t_path, executions, case when k=2 and z=1 then case when p=0 then 0.01 else 0.99 end else p end prob from q3"""))
def _(spark, d):
    return GR.repair_probabilities(_probs(spark, d))


@query("c13_removal", sql("l8", "with " + CONF + " select caseid, task, pos from l8 where caseid in (select caseid from cf where conformant)"))
def _(spark, d):
    log = l8(spark, d)
    return C.keep_conformant(log, C.conformance(log, GR.next_tasks(*graph8(spark, d)))).select("caseid", "task", "pos")


@query("c14_replacement", sql("l8", "with " + CONF + """,
sq as (select caseid, min(start_ts) st, string_agg(chr(47 + cd::int), '' order by start_ts, pos) s, bool_and(conformant) ok from l8 join (select task, dense_rank() over (order by task) cd from (select distinct task from l8) z) c using (task) join cf using (caseid) group by caseid),
va as (select distinct s from sq where not ok), vb as (select s, caseid, st from sq where ok),
nr as (select va.s, arg_min(caseid, (damerau_levenshtein(va.s, vb.s), st, caseid)) nearest from va, vb group by va.s)
select l8.caseid, task, pos from l8 join cf using (caseid) where conformant
union all select concat(sq.caseid, 'R'), l8.task, l8.pos from sq join nr using (s) join l8 on l8.caseid=nr.nearest where not ok"""))
def _(spark, d):
    log = l8(spark, d)
    return C.replace_nonconformant(log, C.conformance(log, GR.next_tasks(*graph8(spark, d)))).select("caseid", "task", "pos")


MOVES = """tn as (select count(*) filter (cast(caseid as int) >= 0) x from l4),
mv as (select caseid, 3*pos + k m, case when k=0 then case when pos % 5 = 0 then 'L' else 'LMGOOD' end else 'MREAL' end move, case when k=0 then task else concat('x', cast(pos % 3 as varchar)) end task
  from l4, (select unnest([0,1,2]) k) kk where k=0 or (k=1 and pos % 7 = 1) or (k=2 and pos % 21 = 1)),
cs as (select distinct caseid, case cast(caseid as int) % 4 when 0 then 1.0 when 1 then 0.0 else 0.5 end fitness from l4)"""


def _moves(life):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    m = life.select("caseid", "pos", "task", k).filter("k = 0 or (k = 1 and pos % 7 = 1) or (k = 2 and pos % 21 = 1)")
    return m.select(
        F.col("caseid").alias("trace_type"),
        (3 * F.col("pos") + F.col("k")).alias("m"),
        F.when(F.col("k") > 0, "MREAL").when(F.col("pos") % 5 == 0, "L").otherwise("LMGOOD").alias("move"),
        F.when(F.col("k") > 0, F.concat(F.lit("x"), (F.col("pos") % 3).cast("string"))).otherwise(F.col("task")).alias("task"),
    )


@query("c15_apply_alignment", sql("l4", "with " + MOVES + """,
pl as (select mv.*, sum((move in ('LMGOOD','L'))::int) over w j, sum((move='MREAL')::int) over w re from mv join cs using (caseid) where fitness=0.5 window w as (partition by caseid order by m)),
jn as (select pl.caseid, pl.m, pl.move, pl.task mt, pl.re, l4.task, l4."user" as "user", l4.ts, l4.transition, min(l4.ts) over (partition by pl.caseid) dummy from pl left join l4 on l4.caseid=pl.caseid and l4.pos=pl.j and pl.move='LMGOOD'),
ft as (select caseid, arg_min(ts, pos) f from l4 group by 1),
bs as (select jn.*, f, last_value(case when move='LMGOOD' then ts end ignore nulls) over w b, last_value(case when move='LMGOOD' then re end ignore nulls) over w br from jn join ft using (caseid) window w as (partition by caseid order by m rows between unbounded preceding and current row))
select caseid, task, "user", ts, transition, 2*m pos from bs where move='LMGOOD'
union all select caseid, mt, 'AUTO', coalesce(b, f) + to_microseconds((case when b is null then re-1 else re-br end)::bigint), t, 2*m+h from bs, (values ('complete',0),('start',1)) v(t,h) where move='MREAL'
union all select caseid, task, "user", ts, transition, pos from l4 join cs using (caseid) where fitness=1"""))
def _(spark, d):
    life = l4(spark, d)
    c = F.col("caseid").cast("int") % 4
    cases = life.select("caseid").distinct().select("caseid", F.col("caseid").alias("trace_type"), F.when(c == 0, 1.0).when(c == 1, 0.0).otherwise(0.5).alias("fitness"))
    return C.apply_alignment(life, cases, _moves(life))


@query("g16_task_parameters", sql("l8", "with recursive " + ROLES.format(v="l8", t="0.1") + ", " + FIT.format(v="l8").replace(" n as ", " n9 as ").replace("g as (select b.*", "gg as (select b.*").replace("from g left join c on c.task=g.task and c.k=g.k", "from gg left join c on c.task=gg.task and c.k=gg.k").replace("select g.*, lo", "select gg.*, lo").replace("(g.k+0.5)", "(gg.k+0.5)").replace("f as (select s.*", "ff as (select s.*").replace("arg2 from f)", "arg2 from ff)") + """,
au as (select distinct task from l8),
rc as (select task, role, count(*) n from l8 join roles using ("user") group by 1,2),
dr as (select task, role from (select *, row_number() over (partition by task order by n desc, role) r from rc) z where r=1)
select au.task, concat('task:', au.task) element_id, dname, mean, arg1, arg2, role pool from au join fit using (task) left join dr using (task)
union all select 'Start', 'task:Start', 'FIXED', 0, 0, 0, 'SYSTEM' union all select 'End', 'task:End', 'FIXED', 0, 0, 0, 'SYSTEM'"""))
def _(spark, d):
    log = l8(spark, d)
    nodes, _ = graph8(spark, d)
    return G.task_parameters(log, nodes, G.discover_roles(log, 0.1))


# ---- work in progress

WLOG = AUG.replace("select caseid, 'Start'", "select caseid, 'Start'")
ROLE_LOG = R2 + ", au as (" + AUG + """), lg as (select au.*, role from au left join roles using ("user")),
ch as (select *, start_ts ts, 1 c from lg union all select *, end_ts, -1 from lg)"""


def role_log(spark, d):
    log = l2(spark, d)
    roles = G.discover_roles(log, 0.85)
    return G.with_roles(S.add_start_end(log), roles), roles


@query("w1_expanded", sql("l2", "with au as (" + AUG + """)
select caseid, task, ts, transition, row_number() over (order by ts, late, pos, caseid, task) n from (select caseid, task, start_ts ts, 'start' transition, pos, 0 late from au union all select caseid, task, end_ts, 'complete', pos, 1 from au) z"""))
def _(spark, d):
    return X.expanded(S.add_start_end(l2(spark, d))).select("caseid", "task", "ts", "transition", "n")


WIPS = """, pw as (select ts, sum(sum(case when task='Start' and c=1 then 1 when task='End' and c=-1 then -1 else 0 end)) over (order by ts) wip from ch group by ts),
tw as (select task, ts, sum(sum(c)) over (partition by task order by ts) t_wip from ch where task not in ('Start','End') and role is not null group by task, ts),
rs as (select role, count(*) size from roles group by role),
oc as (select role, ts, sum(sum(c)) over (partition by role order by ts) act from ch where task not in ('Start','End') and role is not null group by role, ts),
oo as (select role, ts, act/size occupancy from oc join rs using (role))"""


@query("w2_wip", sql("l2", ROLE_LOG + WIPS + " select * from pw"))
def _(spark, d):
    return X.process_wip(S.add_start_end(l2(spark, d)))


@query("w3_task_wip", sql("l2", ROLE_LOG + WIPS + " select * from tw"))
def _(spark, d):
    return X.task_wip(role_log(spark, d)[0])


@query("w4_occupancy", sql("l2", ROLE_LOG + WIPS + " select role, ts, round(occupancy,9) occupancy from oo"))
def _(spark, d):
    return X.role_occupancy(*role_log(spark, d)).withColumn("occupancy", F.round("occupancy", 9))


@query("w5_features_own_role", sql("l2", ROLE_LOG + WIPS + """,
x as (select *, lead(role) over (partition by caseid order by start_ts, pos) next_role from lg)
select x.caseid, x.pos, x.task, p1.wip st_wip, p2.wip end_wip, t1.t_wip st_t_wip, t2.t_wip end_t_wip, round(o1.occupancy,9) st_oc, round(o2.occupancy,9) end_oc, round(coalesce(o3.occupancy,0),9) next_oc
from x left join pw p1 on p1.ts=x.start_ts left join pw p2 on p2.ts=x.end_ts left join tw t1 on t1.ts=x.start_ts and t1.task=x.task left join tw t2 on t2.ts=x.end_ts and t2.task=x.task
left join oo o1 on o1.ts=x.start_ts and o1.role=x.role left join oo o2 on o2.ts=x.end_ts and o2.role=x.role asof left join oo o3 on o3.role=x.next_role and o3.ts<=x.start_ts"""))
def _(spark, d):
    f = X.attach_features(*role_log(spark, d), mode="own")
    return f.select("caseid", "pos", "task", "st_wip", "end_wip", "st_t_wip", "end_t_wip", *[F.round(c, 9).alias(c) for c in ("st_oc", "end_oc", "next_oc")])


@query("w5_features_all_roles", sql("l2", ROLE_LOG + WIPS + """, y as (select distinct role from oo)
select x.caseid, x.pos, y.role, round(coalesce(o.occupancy,0),9) occ from lg x cross join y asof left join oo o on o.role=y.role and o.ts<=x.start_ts where x.task not in ('Start','End')"""))
def _(spark, d):
    log, roles = role_log(spark, d)
    f = X.attach_features(log, roles, mode="all", dual=False).filter(~F.col("task").isin("Start", "End"))
    cols = [c for c in f.columns if c.endswith("_st_oc")]
    pairs = F.array(*[F.struct(F.initcap(F.replace(F.lit(c[: -len("_st_oc")]), F.lit("_"), F.lit(" "))).alias("role"), F.round(c, 9).alias("occ")) for c in cols])
    return f.select("caseid", "pos", F.explode(pairs).alias("e")).select("caseid", "pos", "e.role", "e.occ")


@query("w6_mean_states", sql("l2", ROLE_LOG + WIPS + """,
al as (select ts, row_number() over (order by ts) i, count(*) over () n from pw),
tt as (select task, t_wip, i, n, lead(i) over (partition by task order by i) u from tw join al using (ts))
select null task, round(avg(wip),6) mean from pw union all select task, round(sum(t_wip*(coalesce(u,n+1)-i))/max(n),6) from tt group by task"""))
def _(spark, d):
    return X.mean_states(role_log(spark, d)[0]).withColumn("mean", F.round("mean", 6))
