"""Completing and drawing synthetic logs: t1-t10, f13, f14, a9-a11."""

from pyspark.sql import functions as F

from caseloom.model import ORDER
from caseloom.operators import arrivals as A
from caseloom.operators import blocks as B
from caseloom.operators import context as X
from caseloom.operators import flow as W
from caseloom.operators import profile as G
from caseloom.operators import sample as P
from caseloom.operators import shape as S
from checks.base import l2, l3, l4, l4s, query, sql, table
from checks.flow import RUNS, SEQ

FIFO = """s as (select *, row_number() over (partition by caseid, task, "user", transition order by pos) k from {v}),
fp as (select a.caseid, a.task, a."user" as "user", a.pos, b.pos end_pos, a.ts start_ts, b.ts end_ts, epoch_us(b.ts)-epoch_us(a.ts) proc_us from s a join s b on a.caseid=b.caseid and a.task=b.task and a."user"=b."user" and a.k=b.k and a.transition='start' and b.transition='complete')"""
CTX = FIFO + ", " + RUNS + """, al as (select fp.*, lk.last_act, lk.preceding, lk.wait_us from fp join lk on lk.caseid=fp.caseid and lk.pos=fp.pos),
sa as (select last_act, task, 'pro' kind, proc_us/1e6 secs from al where last_act is not null union all select last_act, task, 'wait', wait_us/1e6 from al where last_act is not null)"""


def _join(df, *cols):
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


@query("t1_context_times", sql("l4", "with " + CTX.format(v="l4") + " select * from sa"))
def _(spark, d):
    return _join(X.context_times(l4(spark, d)), "last_act")


@query("t2_mixture", sql("l4", "with " + CTX.format(v="l4") + """,
m as (select last_act, task, kind, count(*) n, count(*) filter (secs=0) z, count(distinct secs) filter (secs<>0) o, max(secs) filter (secs<>0) v from sa group by 1,2,3)
select last_act, task, kind, 'zero' component, 0.0 "value", round(z/n,9) prob from m where z>0
union all select last_act, task, kind, case when o=1 then 'single' else 'kde' end, case when o=1 then v end, round((n-z)/n,9) from m where o>0"""))
def _(spark, d):
    return _join(X.mixture(X.context_times(l4(spark, d))), "last_act").withColumn("prob", F.round("prob", 9))


def task_vectors(spark, d):
    """Vector per task: mean of the embeddings whose label is the task's code minus 1."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    m = e.groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vec"))
    codes = S.task_codes(l2(spark, d)).select(F.col("task").alias("name"), (F.col("code") - 1).alias("label"))
    return codes.join(m, "label").select("name", "vec")


VEC = """mv as (select label, k, round(avg(x),6) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding,1) k from embeddings) z group by 1,2),
cd as (select task name, row_number() over (order by task) - 1 label from (select distinct task from l2) z),
tv as (select name, k, x from cd join mv using (label))"""


@query("t4_knn_context", sql("l4", "with " + CTX.format(v="l4") + ", " + VEC + """,
cx as (select distinct last_act, task from sa), ce as (select distinct last_act, name, i from (select last_act, unnest(string_split(last_act, ',')) name, generate_subscripts(string_split(last_act, ','),1) i from (select distinct last_act from cx) z) y),
cv as (select last_act, k, sum(x) x from ce join tv using (name) group by 1,2),
ds as (select cx.task, cx.last_act, round(sqrt(sum((tv.x-cv.x)**2)),9) dist from cx join tv on tv.name=cx.task join cv on cv.last_act=cx.last_act and cv.k=tv.k group by 1,2)
select task, last_act, round(dist,6) dist, rank from (select *, row_number() over (partition by task order by dist, string_split(last_act,',')) rank from ds) z where rank<=3"""))
def _(spark, d):
    n = X.nearest_contexts(X.context_times(l4(spark, d)), task_vectors(spark, d))
    return _join(n, "last_act").withColumn("dist", F.round("dist", 6))


@query("t6_assemble_links", sql("l4s", "with " + CTX.format(v="l4s") + " select caseid, pos idx, task, start_ts, end_ts from al"))
def _(spark, d):
    a = B.activity_links(B.add_boundaries(l4s(spark, d)))
    first = a.groupBy("caseid").agg(F.min("start_ts").alias("arrival"))
    seqs = a.join(first, "caseid").select("caseid", F.col("pos").alias("idx"), F.col("end_pos").alias("key"), F.col("preceding").alias("last"), "wait_us", "proc_us", "arrival", "task")
    out = X.assemble_links(seqs).filter(~F.col("task").isin(W.ADD_START, W.ADD_END))
    return out.select("caseid", "idx", "task", "start_ts", "end_ts")


@query("t6_assemble_linear", sql("l2", """with x as (select *, row_number() over w - 1 idx, epoch_us(end_ts)-epoch_us(start_ts) p,
 greatest(coalesce(epoch_us(start_ts)-epoch_us(lag(end_ts) over w),0),0) wt, min(start_ts) over (partition by caseid) ar from l2 window w as (partition by caseid order by start_ts, pos)),
y as (select *, sum(p+wt) over (partition by caseid order by idx) dn from x)
select caseid, idx, ar + to_microseconds((dn-p)::bigint) start_ts, ar + to_microseconds(dn::bigint) end_ts from y"""))
def _(spark, d):
    log = S.positions(S.durations(l2(spark, d)))
    first = log.groupBy("caseid").agg(F.min("start_ts").alias("arrival"))
    seqs = log.join(first, "caseid").select("caseid", (F.col("pos_trace") - 1).alias("idx"), "wait_us", "proc_us", "arrival")
    return X.assemble_linear(seqs).select("caseid", "idx", "start_ts", "end_ts")


def parity():
    return F.regexp_extract("caseid", "-([0-9]+)$", 1).cast("int") % 2


def gen_train(spark, d):
    """Occurrence labels of the odd-day sessions (generated) and the even-day ones (training)."""
    lb = S.occurrence_labels(l3(spark, d))
    return lb.filter(parity() == 1), lb.filter(parity() == 0)


LB = """lb as (select *, cast(regexp_extract(caseid,'-([0-9]+)$',1) as int) % 2 side, concat(task, cast(row_number() over (partition by caseid, task order by start_ts, pos)-1 as varchar)) label from l3),
ws as (select caseid, "user", list(label order by pos) w from lb where side=0 group by 1,2),
pa as (select caseid, list_sort(list(distinct w)) comb from ws group by 1),
ls as (select caseid, side, list_sort(list(distinct label)) labels from lb group by 1,2),
tr as (select labels, comb, count(*) n from ls join pa using (caseid) where side=0 group by 1,2),
ge as (select distinct labels gen from ls where side=1)"""
CMB = "array_to_string(list_transform(comb, lambda w: array_to_string(w, ',')), ';') comb"
PART = """select array_to_string(gen, ',') gen, """ + CMB + """, sum(n)::bigint n, round(sum(n)/sum(sum(n)) over (partition by gen),10) prob from cd group by gen, comb"""
KNOWN = LB + """, cd as (select gen, comb, n from ge, tr where gen in (select labels from tr) and list_has_all(labels, gen)
 and len(list_filter(comb, lambda w: len(list_intersect(w, gen)) > 0 and len(list_intersect(w, gen)) < len(w))) = 0)"""


def _parts(df):
    return df.select(F.array_join("gen", ",").alias("gen"), F.array_join(F.transform("comb", lambda w: F.array_join(w, ",")), ";").alias("comb"), "n", "prob")


@query("t7_covering_partitions", sql("l3", "with " + KNOWN + " " + PART))
def _(spark, d):
    gen, train = gen_train(spark, d)
    return _parts(X.covering_partitions(X.label_sets(gen).select("labels").distinct(), X.partitions_of(train)))


@query("t8_nearest_partitions", sql("l3", "with " + LB + """, vc as (select label, 47 + row_number() over (order by label) c from (select distinct label from lb) z),
st as (select labels, string_agg(chr(c::int), '' order by i) s from (select labels, unnest(labels) label, generate_subscripts(labels,1) i from (select gen labels from ge union select labels from tr) q) z join vc using (label) group by labels),
un as (select gen, s from ge join st on st.labels=gen where gen not in (select labels from tr)),
ot as (select distinct labels, s from tr join st using (labels)),
ds as (select gen, labels, levenshtein(un.s, ot.s) dd from un, ot),
cd as (select gen, comb, n from (select *, min(dd) over (partition by gen) mn from ds) z join tr using (labels) where dd=mn)
""" + PART))
def _(spark, d):
    gen, train = gen_train(spark, d)
    return _parts(X.nearest_partitions(X.label_sets(gen).select("labels").distinct(), X.partitions_of(train)))


@query("t9_assign_resources", None)
def _(spark, d):
    gen, train = gen_train(spark, d)
    sets = X.label_sets(gen).select("labels").distinct()
    tr = X.partitions_of(train)
    parts = X.covering_partitions(sets, tr).unionByName(X.nearest_partitions(sets, tr))
    probs = G.resource_given_workset(G.work_sets(train))
    return P.assign_resources(gen.drop("user", "seg"), parts, probs, G.task_user_counts(train)).select("caseid", "pos", "task", "label", "resource")


@query("t10_canonical", sql("l2", """select concat('Case', cast(cast(caseid as bigint)+1 as varchar)) caseid, task, start_ts, end_ts, "user" resource from l2"""))
def _(spark, d):
    return X.canonical(l2(spark, d), shift=1)


@query("t3_draw_times", None)
def _(spark, d):
    s = X.context_times(l4(spark, d))
    rows = B.activity_links(l4(spark, d)).filter("last_act is not null").select(F.xxhash64("caseid", "pos").alias("id"), "last_act", "task")
    return _join(P.draw_times(rows, X.mixture(s), P.sample_table(s), "wait", "secs", seed=5), "last_act")


@query("t5_unseen_times", None)
def _(spark, d):
    s = X.context_times(l4(spark, d))
    near = X.nearest_contexts(s, task_vectors(spark, d))
    rows = l2(spark, d).select(F.col("pos").alias("id"), "task")
    return P.draw_unseen(rows, near, X.mixture(s), P.sample_table(s), "pro", "secs", seed=5)


@query("f13_cumulative_bounds", sql("l3", "with " + SEQ.format(v="l3", o="start_ts,pos") + """,
p as (select q[i] ctx, q[i+1] nxt from (select q, unnest(range(1, len(q))) i from s) z),
m as (select ctx, nxt, count(*) n, round(count(*)/sum(count(*)) over (partition by ctx),10) prob from p group by 1,2)
select ctx, nxt, round(sum(prob) over w - prob,6) cum_lo, case when lead(1) over w is null then 2.0 else round(sum(prob) over w,6) end cum_hi from m window w as (partition by ctx order by nxt)"""))
def _(spark, d):
    m = W.with_bounds(W.transitions(W.ngram_pairs(W.bounded_sequences(l3(spark, d)), 2)), ["ctx"], "nxt")
    return m.select(F.array_join("ctx", ">").alias("ctx"), "nxt", F.round("cum_lo", 6).alias("cum_lo"), F.round("cum_hi", 6).alias("cum_hi"))


def _cases(spark, d):
    return S.case_count(l3(spark, d)).first()["cases"]


@query("f13_sample_prefix", None)
def _(spark, d):
    return P.sample_trie(spark, W.prefix_trie(l3(spark, d), ORDER), _cases(spark, d)).select("caseid", F.array_join("seq", ">").alias("seq"))


@query("f13_sample_trigram", None)
def _(spark, d):
    model = W.transitions(W.ngram_pairs(W.bounded_sequences(l3(spark, d)), 3))
    return P.sample_sequences(spark, model, _cases(spark, d), ngram=3).select("caseid", F.array_join("seq", ">").alias("seq"))


def step_model(life):
    """Bigram model over steps (tasks and blocks)."""
    steps = B.step_sequence(B.add_boundaries(life))
    seqs = steps.groupBy("caseid").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "token"))), lambda s: s["token"]).alias("seq"))
    return W.transitions(W.ngram_pairs(seqs, 2))


@query("f14_expand_blocks", None)
def _(spark, d):
    life = l4s(spark, d)
    seqs = P.sample_sequences(spark, step_model(life), _cases(spark, d), ngram=2)
    return P.expand_blocks(seqs, B.block_model(B.add_boundaries(life)))


@query("a9_synthetic_arrivals", None)
def _(spark, d):
    arr = A.case_arrivals(l3(spark, d))
    s = arr.agg(F.max("ts").alias("t"), F.count("*").alias("n")).first()
    return P.arrivals_from_rates(A.rate_table(A.dense_hours(arr)), s["t"], s["n"])


@query("a10_arrivals_from_gaps", None)
def _(spark, d):
    arr = A.case_arrivals(l3(spark, d))
    s = arr.agg(F.min("ts").alias("t"), F.count("*").alias("n")).first()
    dist = G.fit_distributions(A.gaps_global(arr).withColumn("all", F.lit(0)), ["all"], "inter_time")
    return P.arrivals_from_gaps(dist, s["t"], s["n"])


@query("a10_arrivals_from_windows", None)
def _(spark, d):
    arr = A.case_arrivals(l3(spark, d))
    s = arr.agg(F.max("ts").alias("t"), F.count("*").alias("n")).first()
    return P.arrivals_from_windows(P.window_model(A.window_gaps(arr)), s["t"], s["n"])


@query("a11_best_window", None)
def _(spark, d):
    arr = A.case_arrivals(l3(spark, d))
    early = F.day("ts") <= 24
    return P.best_window(P.window_model(A.window_gaps(arr.filter(early))), arr.filter(~early))


@query("flow_generate_log", None)
def _(spark, d):
    from caseloom.plans.generate import generate

    train = l3(spark, d)
    s = train.groupBy("caseid").agg(F.min("start_ts").alias("s")).agg(F.max("s").alias("t"), F.count("*").alias("n")).first()
    return generate(train, l4s(spark, d), task_vectors(spark, d), s["n"], s["t"])
