"""Control flow: f1-f12, f15."""

from pyspark.sql import functions as F

from caseloom.model import ORDER
from caseloom.operators import blocks as B
from caseloom.operators import flow as W
from caseloom.operators import profile as G
from caseloom.operators import shape as S
from checks.base import l2, l3, l4, l4s, l6, l7, query, sql
from checks.profile import R2

DFG = """d as (select a, b, count(*) n from (select task a, lead(task) over (partition by caseid order by start_ts, pos) b from {v}) z where b is not null group by 1,2)"""


@query("f1_dfg", sql("l2", "with " + DFG.format(v="l2") + " select * from d"))
def _(spark, d):
    return W.directly_follows(l2(spark, d))


@query("f1_dfg_fine_tasks", sql("l7", "with " + DFG.format(v="l7") + " select * from d"))
def _(spark, d):
    return W.directly_follows(l7(spark, d))


FOOT = DFG + """,
t as (select distinct task from {v}),
r as (select x.task a, y.task b, (select count(*) from d where d.a=x.task and d.b=y.task) ab, (select count(*) from d where d.a=y.task and d.b=x.task) ba from t x cross join t y),
s as (select task a, lead(task) over w b, lead(task,2) over w c, row_number() over w - 1 i from {v} window w as (partition by caseid order by {o})),
lp as (select distinct a, b from s where i % 2 = 0 and a = c),
lo as (select a, b from lp union select b, a from lp),
base as (select a, b, case when a=b then case when ab>0 then 'FOLLOWS' else 'NOT_CONNECTED' end when ab>0 and ba>0 then 'PARALLEL' when ab>0 then 'PRECEDES' when ba>0 then 'FOLLOWS' else 'NOT_CONNECTED' end rel from r),
foot as (select a, b, case when exists (select 1 from lo where lo.a=base.a and lo.b=base.b) then 'PRECEDES' else rel end rel from base)"""


@query("f2_footprint", sql("l7", "with " + FOOT.format(v="l7", o="start_ts, pos") + " select * from base"))
def _(spark, d):
    return W.footprint(l7(spark, d), loops=False)


@query("f3_footprint_loops", sql("l7", "with " + FOOT.format(v="l7", o="start_ts, pos") + " select * from foot"))
def _(spark, d):
    return W.footprint(l7(spark, d))


@query("f4_variants", sql("l3", "with s as (select caseid, string_agg(task,'>' order by start_ts,pos) seq from l3 group by 1) select seq, count(*) n from s group by 1"))
def _(spark, d):
    return W.variants(l3(spark, d)).withColumn("seq", F.array_join("seq", ">"))


@query("f4_variants_conversations", sql("l6", "with s as (select caseid, string_agg(task,'>' order by pos) seq from l6 group by 1) select seq, count(*) n from s group by 1"))
def _(spark, d):
    return W.variants(l6(spark, d), ["pos"]).withColumn("seq", F.array_join("seq", ">"))


AUG7 = """au as (select caseid, task, start_ts, pos from l7
 union all select caseid, 'Start', min(start_ts) - interval 1 microsecond, min(pos)-1 from l7 group by caseid
 union all select caseid, 'End', max(end_ts) + interval 1 microsecond, max(pos)+1 from l7 group by caseid)"""
GRAPH = AUG7 + ", " + DFG.format(v="au") + """,
k as (select d.a, d.b, d.n, coalesce(r.n,0) back from d left join d r on d.a=r.b and d.b=r.a),
f as (select a, b, n from k where a=b or back=0 or not abs(n-back)/(n+back) < 0.3),
g as (select a, b, n from (select *, row_number() over (partition by a order by n desc, b) ro, row_number() over (partition by b order by n desc, a) ri from f) z
  where n >= (select quantile_cont(n, 0.4) from f) or ro=1 or ri=1)"""


def graph_edges(spark, d):
    return W.filtered_graph(W.directly_follows(S.add_start_end(l7(spark, d))))


@query("f5_filtered_graph", sql("l7", "with " + GRAPH + " select * from g"))
def _(spark, d):
    return graph_edges(spark, d)


def _model(df):
    return df.select(F.array_join("ctx", ">").alias("ctx"), "nxt", "n", "prob")


TRANS = " select ctx, nxt, count(*) n, round(count(*)/sum(count(*)) over (partition by ctx),10) prob from p group by ctx, nxt"
SEQ = "s as (select caseid, list_concat(['addstart'], list_concat(list(task order by {o}), ['addend'])) q from {v} group by caseid)"


@query("f6_prefix_model", sql("l3", "with " + SEQ.format(v="l3", o="start_ts,pos") + """,
p as (select array_to_string(q[1:i],'>') ctx, q[i+1] nxt from (select q, unnest(range(1, len(q))) i from s) z)""" + TRANS))
def _(spark, d):
    log = l3(spark, d)
    return _model(W.with_contexts(W.prefix_trie(log, ORDER), log, ORDER))


@query("f6_prefix_model_conversations", sql("l6", "with " + SEQ.format(v="l6", o="pos") + """,
p as (select array_to_string(q[1:i],'>') ctx, q[i+1] nxt from (select q, unnest(range(1, len(q))) i from s) z)""" + TRANS))
def _(spark, d):
    log = l6(spark, d)
    return _model(W.with_contexts(W.prefix_trie(log, ["pos"]), log, ["pos"]))


NGRAM = """, z as (select q, len(q) l from s),
g as (select q g from z where l <= {n}
 union all select q[i:i+{n}-1] from (select q, unnest(range(1, l-{n}+2)) i from z where l > {n}) a
 union all select q[1:k] from (select q, unnest(range(2, {n})) k from z where l > {n}) b
 union all select q[l-k+1:l] from (select q, l, unnest(range(2, {n})) k from z where l > {n}) c),
p as (select array_to_string(g[1:len(g)-1],'>') ctx, g[len(g)] nxt from g)"""


@query("f7_bigram_model", sql("l3", "with " + SEQ.format(v="l3", o="start_ts,pos") + NGRAM.format(n=2) + TRANS))
def _(spark, d):
    return _model(W.transitions(W.ngram_pairs(W.bounded_sequences(l3(spark, d)), 2)))


@query("f7_fourgram_model", sql("l3", "with " + SEQ.format(v="l3", o="start_ts,pos") + NGRAM.format(n=4) + TRANS))
def _(spark, d):
    return _model(W.transitions(W.ngram_pairs(W.bounded_sequences(l3(spark, d)), 4)))


BOUND = """bd as (select caseid, task, "user", ts, transition, pos from {v}
 union all select caseid, 'addstart', 'addstart', arg_min(ts, pos), t, min(pos)+o from {v}, (values ('start',-2),('complete',-1)) v(t,o) group by caseid, t, o
 union all select caseid, 'addend', 'addend', arg_max(ts, pos), t, max(pos)+o from {v}, (values ('start',1),('complete',2)) v(t,o) group by caseid, t, o)"""


@query("f8_boundaries", sql("l4", "with " + BOUND.format(v="l4") + " select * from bd"))
def _(spark, d):
    return B.add_boundaries(l4(spark, d)).select("caseid", "task", "user", "ts", "transition", "pos")


STEPS = BOUND + """,
b1 as (select *, coalesce(sum(case when transition='start' then 1 else -1 end) over (partition by caseid order by pos rows between unbounded preceding and 1 preceding),0) ob from bd),
b2 as (select *, sum(case when ob=0 then 1 else 0 end) over (partition by caseid order by pos) isl from b1),
isl as (select caseid, isl, count(*)=2 and min(task)=max(task) and min("user")=max("user") and count(distinct transition)=2 simple, min(pos) p from b2 group by 1,2),
i2 as (select *, sum(case when simple or coalesce(lag_s, true) then 1 else 0 end) over (partition by caseid order by isl) step
  from (select *, lag(simple) over (partition by caseid order by isl) lag_s from isl) z),
st as (select b2.*, i2.step, i2.simple from b2 join i2 using (caseid, isl)),
sq as (select caseid, step, arg_min(task, pos) ft, arg_max(task, pos) lt, bool_and(simple) simple, min(pos) first_pos, max(pos) last_pos, count(*) "rows" from st group by 1,2),
ss as (select *, lag(lt) over (partition by caseid order by step) bf, lead(ft) over (partition by caseid order by step) af, lead(first_pos) over (partition by caseid order by step) end_pos from sq),
tk as (select *, case when simple then ft else concat('[', bf, ' | ', af, ']') end token from ss)"""


@query("f9_steps", sql("l4", "with " + STEPS.format(v="l4") + ' select caseid, step, token, first_pos, last_pos, "rows" from tk'))
def _(spark, d):
    return B.step_sequence(B.add_boundaries(l4(spark, d))).select("caseid", "step", "token", "first_pos", "last_pos", "rows")


@query("f9_blocks", sql("l4s", "with " + STEPS.format(v="l4s") + """ select st.caseid, st.step, st.task, st.transition, st.pos, tk.bf "before", tk.af "after"
 from st join tk on st.caseid=tk.caseid and st.step=tk.step where not tk.simple"""))
def _(spark, d):
    return B.parallel_blocks(B.add_boundaries(l4s(spark, d))).select("caseid", "step", "task", "transition", "pos", "before", "after")


RUNS = """r0 as (select *, case when lag(transition) over (partition by caseid order by pos) is distinct from transition then 1 else 0 end ch from {v}),
r1 as (select *, sum(ch) over (partition by caseid order by pos) run,
 last_value(case when transition='complete' then ts end ignore nulls) over (partition by caseid order by pos rows between unbounded preceding and 1 preceding) ld from r0),
mb as (select caseid, run, string_agg(cast(pos as varchar), ',' order by pos) idx, string_agg(task, ',' order by task) names from r1 group by 1,2),
lk as (select r1.caseid, r1.pos, r1.task, r1.ts, r1."user" as "user", r1.transition, r1.run, case when transition='start' then p.idx end preceding, case when transition='start' then p.names end last_act,
 case when transition='complete' then n.idx end nxt, case when transition='complete' then n.names end next_act,
 case when transition='start' then coalesce(epoch_us(ts)-epoch_us(ld),0) end wait_us
 from r1 left join mb p on p.caseid=r1.caseid and p.run=r1.run-1 left join mb n on n.caseid=r1.caseid and n.run=r1.run+1)"""


@query("f10_causal_links", sql("l4", "with " + RUNS.format(v="l4") + " select caseid, pos, run, preceding, nxt, wait_us from lk"))
def _(spark, d):
    k = B.causal_links(l4(spark, d))
    return k.select("caseid", "pos", "run", F.array_join("preceding", ",").alias("preceding"), F.array_join("next", ",").alias("nxt"), "wait_us")


@query("f11_context_names", sql("l4", "with " + RUNS.format(v="l4") + " select caseid, pos, last_act, next_act from lk"))
def _(spark, d):
    k = B.causal_links(l4(spark, d))
    return k.select("caseid", "pos", F.array_join("last_act", ",").alias("last_act"), F.array_join("next_act", ",").alias("next_act"))


@query("f12_block_model", None)
def _(spark, d):
    return B.block_model(B.add_boundaries(l4s(spark, d)))


@query("f12_first_tasks", sql("l4s", "with " + STEPS.format(v="l4s") + """,
fc as (select caseid, step, min(pos) fc from st where not simple and transition='complete' group by 1,2),
ff as (select st.caseid, st.step, string_agg(st.task, '+' order by st.task) item from st join fc on st.caseid=fc.caseid and st.step=fc.step where transition='start' and pos < fc group by 1,2),
jj as (select token, item from ff join tk using (caseid, step))
select token, item, count(*) n, round(count(*)/sum(count(*)) over (partition by token),10) prob from jj group by 1,2"""))
def _(spark, d):
    m = B.block_model(B.add_boundaries(l4s(spark, d)))
    names = F.transform("item", lambda e: F.element_at(e["names"], 1))
    return m.filter("kind = 'first'").select("token", F.array_join(names, "+").alias("item"), "n", "prob")


@query("f15_role_sequences", sql("l2", R2 + """, c as (select task, role, count(*) n from l2 join roles using ("user") group by 1,2),
dr as (select task, role from (select *, row_number() over (partition by task order by n desc, role) r from c) z where r=1),
ix0 as (select task, min(pos) p from l2 group by 1), ix as (select task, row_number() over (order by p, task) id from ix0)
select x.caseid, x.pos, ix.id ac_index, coalesce(i2.id, (select count(*)+1 from ix)) next_index, dr.role
from (select *, lead(task) over (partition by caseid order by start_ts, pos) nxt from l2) x join ix using (task) left join ix i2 on i2.task=x.nxt left join dr on dr.task=x.task"""))
def _(spark, d):
    log = l2(spark, d)
    return W.role_sequences(log, G.discover_roles(log, 0.85), S.category_index(log, "task"), "Role 1")
