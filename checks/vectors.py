"""Embeddings v1-v12 and samples n1-n8."""

from pyspark.sql import functions as F

from caseloom.operators import arrivals as A
from caseloom.operators import embed as E
from caseloom.operators import profile as G
from caseloom.operators import samples as N
from caseloom.operators import shape as S
from caseloom.operators import split as P
from checks.base import l2, l3, l7, query, sql, table
from checks.profile import R2
from checks.synthetic import VEC, task_vectors


@query("v1_width", sql("l7", """select count(distinct task) tasks, count(distinct "user") users, cast(ceil(round((count(distinct task)*count(distinct "user"))**0.25,9)) as int) width from l7"""))
def _(spark, d):
    return E.embedding_width(l7(spark, d))


@query("v2_training_pairs", None)
def _(spark, d):
    return E.training_pairs(l7(spark, d))


@query("v2_pair_counts", sql("l7", """with n as (select cast(ceil(count(*)/2) as bigint) k from l7),
m as (select count(*) m from (select task, u from (select distinct task from l7) a, (select distinct "user" u from l7) b except select task, "user" from l7) z)
select 1 y, k n from n union all select 0, 2*k from n, m where m > 0"""))
def _(spark, d):
    return E.training_pairs(l7(spark, d)).groupBy("y").agg(F.count("*").alias("n"))


@query("v2_unobserved", sql("l7", """select task, u "user" from (select distinct task from l7) a, (select distinct "user" u from l7) b except select task, "user" from l7"""))
def _(spark, d):
    return E.unobserved_pairs(l7(spark, d), ["task", "user"]).select("task", "user")


@query("v3_factor_embedding", None)
def _(spark, d):
    log = l7(spark, d)
    return E.factor_embedding(G.task_user_counts(log), E.embedding_width(log).first()["width"])


@query("v3b_factor_embedding_times", None)
def _(spark, d):
    log = l7(spark, d)
    return E.factor_embedding_times(S.duration_bins(log), E.embedding_width(log).first()["width"])


@query("v4_single_sentences", sql("l2", """select caseid, pos, concat(task, ' ', "user") words from l2"""))
def _(spark, d):
    return E.sentences(l2(spark, d), "single", ["task", "user"]).withColumn("words", F.array_join("words", " "))


@query("v4_full_sentences", sql("l2", """select caseid, string_agg(concat(task, ' ', "user"), ' ' order by start_ts, pos) words from l2 group by caseid"""))
def _(spark, d):
    return E.sentences(l2(spark, d), "full", ["task", "user"]).withColumn("words", F.array_join("words", " "))


@query("v4_channels", sql("l2", """select caseid, 'task' channel, string_agg(task, ' ' order by start_ts, pos) words from l2 group by caseid
union all select caseid, 'user', string_agg("user", ' ' order by start_ts, pos) from l2 group by caseid"""))
def _(spark, d):
    return E.sentences(l2(spark, d), "channel", ["task", "user"]).withColumn("words", F.array_join("words", " "))


@query("v5_token_embedding", None)
def _(spark, d):
    log = l2(spark, d)
    return E.token_embedding(E.sentences(log, "full", ["task", "user"]), E.embedding_width(log).first()["width"])


def user_vectors(spark, d):
    """Vector per resource: mean of the embeddings whose label is the resource's number modulo 10."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    m = e.groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vec"))
    users = l2(spark, d).select("user").distinct().withColumn("label", F.substring("user", 2, 9).cast("int") % 10)
    return users.join(m, "label").select(F.col("user").alias("name"), "vec")


@query("v6_weighted_embedding", sql("l2", "with " + VEC + """,
sh as (select task, "user" u, count(*)/sum(count(*)) over (partition by task) p from l2 group by 1,2),
su as (select task, k, sum(p*x) s from sh join mv on mv.label = cast(substring(u,2) as int) % 10 group by 1,2)
select tv.name, tv.k::int - 1 k, round(tv.x*s,6) x from tv join su on su.task=tv.name and su.k=tv.k"""))
def _(spark, d):
    w = E.weighted_embedding(l2(spark, d), task_vectors(spark, d), {"user": user_vectors(spark, d)})
    return w.select("name", F.posexplode("vec").alias("k", "x")).withColumn("x", F.round("x", 6))


def points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("cluster"))


@query("v7_kmeans", None)
def _(spark, d):
    return E.clusters(points(spark, d).drop("cluster"), "kmeans").select("id", "cluster")


@query("v7_gaussian_mixture", None)
def _(spark, d):
    return E.clusters(E.decompose(points(spark, d).drop("cluster"), "pca"), "gmm").select("id", "cluster")


@query("v7_mean_shift", None)
def _(spark, d):
    return E.clusters(E.decompose(points(spark, d).drop("cluster"), "pca"), "mean_shift", bandwidth=0.4).select("id", "cluster")


@query("v8_pca", None)
def _(spark, d):
    return E.decompose(points(spark, d), "pca")


@query("v8_svd", None)
def _(spark, d):
    return E.decompose(points(spark, d), "svd")


PTS = """pt as (select vec_id id, embedding::double[] v, label cl, {m} mm from embeddings)"""
SIL = """ds as (select a.mm, a.id, a.c own, b.c other, sum(list_distance(a.v, b.v)) s, count(*) n from pc a join pc b on a.mm=b.mm group by 1,2,3,4),
ab as (select mm, id, max(case when own=other and n>1 then s/(n-1) end) a, min(case when own<>other then s/n end) b from ds group by 1,2),
sl as (select mm, avg(case when a is null or greatest(a,b)=0 then 0 else (b-a)/greatest(a,b) end) silhouette from ab group by 1)"""
CHS = """x as (select mm, c, unnest(v) x, generate_subscripts(v,1) k from pc), pk as (select mm, c, k, count(*) n, avg(x) m, sum(x*x) q from x group by 1,2,3),
tk as (select mm, k, avg(x) m from x group by 1,2), pp as (select pk.mm, c, max(n) n, sum(n*(pk.m-tk.m)**2) b, sum(q-n*pk.m*pk.m) w from pk join tk on pk.mm=tk.mm and pk.k=tk.k group by 1,2),
ch as (select mm, sum(b)*(sum(n)-count(*))/(sum(w)*(count(*)-1)) ch from pp group by 1)"""
ONE = "pc as (select 1 mm, vec_id id, embedding::double[] v, label c from embeddings)"
MANY = "pc as (select mm, vec_id id, embedding::double[] v, label % mm c from embeddings, (select unnest([2,3,5,10]) mm) z)"


@query("v9_silhouette", sql("", "with " + ONE + ", " + SIL + " select round(silhouette,6) silhouette from sl"))
def _(spark, d):
    return E.silhouette(points(spark, d)).withColumn("silhouette", F.round("silhouette", 6))


@query("v10_calinski_harabasz", sql("", "with " + ONE + ", " + CHS + " select round(ch,6) calinski_harabasz from ch"))
def _(spark, d):
    return E.calinski_harabasz(points(spark, d)).withColumn("calinski_harabasz", F.round("calinski_harabasz", 6))


@query("v11_best_clustering", sql("", "with " + MANY + ", " + SIL + ", " + CHS + """,
sc as (select mm, round(silhouette,6) silhouette, round(ch,6) calinski_harabasz from sl join ch using (mm))
select 'highest' pick, * from (select * from sc order by silhouette desc, calinski_harabasz desc limit 1) a
union all select 'lowest', * from (select * from sc order by silhouette, calinski_harabasz limit 1) b"""))
def _(spark, d):
    p = points(spark, d)
    rows = E.scores(p, {m: F.col("cluster") % m for m in (2, 3, 5, 10)})
    rows = rows.select(F.col("method").alias("mm"), F.round("silhouette", 6).alias("silhouette"), F.round("calinski_harabasz", 6).alias("calinski_harabasz"))
    hi, lo = E.best_clustering(rows), E.best_clustering(rows, ascending=True)
    return hi.select(F.lit("highest").alias("pick"), "*").unionByName(lo.select(F.lit("lowest").alias("pick"), "*"))


def known_vectors(spark, d):
    """Vectors of the tasks other than the last one in name order."""
    v = task_vectors(spark, d)
    codes = S.task_codes(l2(spark, d)).select(F.col("task").alias("name"), F.col("code").alias("idx"))
    return v.join(codes, "name").select("idx", "name", "vec").filter("name <> 'view'")


@query("v12_extended_names", sql("l2", "with " + VEC + """, kn as (select label+1 idx, name from cd where name <> 'view')
select idx, name, 64 width from kn union all select (select max(idx) from kn)+row_number() over (order by task), task, 64 from (select distinct task from l2 where task not in (select name from kn)) z"""))
def _(spark, d):
    return E.extend_embedding(known_vectors(spark, d), l2(spark, d).select("task")).select("idx", "name", F.size("vec").alias("width"))


@query("v12_extended_embedding", None)
def _(spark, d):
    return E.extend_embedding(known_vectors(spark, d), l2(spark, d).select("task"))


@query("v12_new_task_pairs", None)
def _(spark, d):
    log = l2(spark, d)
    roles = G.discover_roles(log, 0.85)
    new = log.select("task").distinct().filter("task = 'view'")
    return E.new_task_pairs(new, G.dominant_role(log, roles).select("task", "role"), roles, log.count())


# ---- samples

EV = """ix0 as (select task, min(pos) p from l2 group by 1), ix as (select task, row_number() over (order by p, task) id from ix0),
ev as (select l2.caseid, l2.pos, start_ts, id::int ac, coalesce(lead(id::int) over w, 0) nac, (epoch_us(end_ts)-epoch_us(start_ts))/1e6 pr,
 greatest(coalesce(epoch_us(start_ts)-epoch_us(lag(end_ts) over w),0),0)/1e6 wt, (hour(start_ts)*3600+minute(start_ts)*60+second(start_ts))/86400 sd, isodow(start_ts)-1 sw,
 (hour(end_ts)*3600+minute(end_ts)*60+second(end_ts))/86400 ed, isodow(end_ts)-1 ew from l2 join ix using (task) window w as (partition by caseid order by start_ts, l2.pos)),
e2 as (select *, coalesce(lead(wt) over (partition by caseid order by start_ts, pos),0) wn, row_number() over (partition by caseid order by start_ts, pos)-1 i from ev)"""


def ints(c, n, cur=False):
    ks = list(range(n - 1 if cur else n, 0, -1))
    items = [f"cast(coalesce(lag({c},{k}) over w,0) as varchar)" for k in ks] + ([f"cast({c} as varchar)"] if cur else [])
    return "concat_ws(',', " + ", ".join(items) + ")"


def events_of(spark, d):
    log = l2(spark, d)
    return N.event_features(log, S.category_index(log, "task"))


def show(df, days=(), whole=()):
    """Arrays as text, one-hot weekdays as the day."""
    out = {c: F.array_join(F.transform(c, lambda v: (F.array_position(v, 1) - 1).cast("string")), ",") for c in days}
    out |= {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in whole}
    return df.withColumns(out)


def numbers(df, cols, n):
    """Array elements as rounded columns (text of a double differs between engines)."""
    return df.select("*", *[F.round(F.col(c)[k], 9 if c == "daytime" else 6).alias(f"{c}_{k}") for c in cols for k in range(n)]).drop(*cols)


def num_sql(c, name, n, cur=False):
    ks = list(range(n - 1 if cur else n, 0, -1))
    r = 9 if name == "daytime" else 6
    items = [f"round(coalesce(lag({c},{k}) over w,0),{r})" for k in ks] + ([f"round({c},{r})"] if cur else [])
    return ", ".join(f"{x} {name}_{j}" for j, x in enumerate(items))


W = " from e2 window w as (partition by caseid order by start_ts, pos)"


@query("n1_ngrams", sql("l2", "with " + EV + f" select caseid, i ngram_num, {ints('ac',5,True)} ac, {num_sql('sd','daytime',5,True)}, {ints('sw',5,True)} weekday, {num_sql('pr','proc',5)}, {num_sql('wn','wait',5)}, pr y_proc, wn y_wait" + W))
def _(spark, d):
    g = N.sliding_ngrams(events_of(spark, d), 5)
    return numbers(show(g, days=["weekday"], whole=["ac"]), ["daytime", "proc", "wait"], 5)


@query("n2_prefix_proc", sql("l2", "with " + EV + f" select caseid, i ngram_num, {ints('ac',4)} ac, {num_sql('pr','times',4)}, {num_sql('sd','daytime',4)}, {ints('sw',4)} weekday, pr y" + W))
def _(spark, d):
    return numbers(show(N.prefix_ngrams(events_of(spark, d), 4, "proc"), days=["weekday"], whole=["ac"]), ["times", "daytime"], 4)


@query("n2_prefix_wait", sql("l2", "with " + EV + f" select caseid, i ngram_num, {ints('nac',4)} ac, {num_sql('wt','times',4)}, {num_sql('ed','daytime',4)}, {ints('ew',4)} weekday, wt y" + W))
def _(spark, d):
    return numbers(show(N.prefix_ngrams(events_of(spark, d), 4, "wait"), days=["weekday"], whole=["ac"]), ["times", "daytime"], 4)


@query("n3_prefix_next", sql("l2", "with " + EV + f" select caseid, i ngram_num, {ints('ac',4)} ac, {ints('nac',4)} next_ac, {num_sql('pr','procs',4)}, {num_sql('wt','waits',4)}, {num_sql('sd','daytime',4)}, {ints('sw',4)} weekday, pr y_proc, wt y_wait" + W))
def _(spark, d):
    g = show(N.prefix_ngrams_next(events_of(spark, d), 4), days=["weekday"], whole=["ac", "next_ac"])
    return numbers(g, ["procs", "waits", "daytime"], 4)


@query("n4_arrival_ngrams", sql("l3", """with a as (select caseid, min(start_ts) ts from l3 group by caseid),
e2 as (select caseid, ts, coalesce((epoch_us(ts)-epoch_us(lag(ts) over (order by ts, caseid)))/1e6, 0) g, (hour(ts)*3600+minute(ts)*60+second(ts))/86400 dp, isodow(ts)-1 wd from a)
select caseid, """ + num_sql("g", "gaps", 3) + ", " + num_sql("dp", "daytime", 3) + ", " + ints("wd", 3) + " weekday, g y from e2 window w as (order by ts, caseid)"))
def _(spark, d):
    g = N.arrival_ngrams(A.gaps_global(A.case_arrivals(l3(spark, d))), 3)
    return numbers(show(g, days=["weekday"]), ["gaps", "daytime"], 3)


@query("n5_one_hot_weekday", sql("l2", """select caseid, pos, """ + ", ".join(f"(isodow(start_ts)={k + 1})::int day_{k}" for k in range(7)) + " from l2"))
def _(spark, d):
    o = l2(spark, d).withColumn("o", N.one_hot_weekday(F.weekday("start_ts")))
    return o.select("caseid", "pos", *[F.col("o")[k].alias(f"day_{k}") for k in range(7)])


def fitted(spark, d, n=3):
    log = P.timeline_contained(l3(spark, d))
    ids = S.category_index(l3(spark, d), "task")
    rows = lambda part: N.flat_features(N.sliding_ngrams(N.event_features(log.filter(F.col("split") == part), ids), n), n)
    train = N.training_rows(rows("train"))
    models = {t: N.duration_model(train, "y_" + t, n) for t in ("proc", "wait")}
    return models, rows("test"), ids


@query("n6_duration_model", None)
def _(spark, d):
    models, test, _ = fitted(spark, d)
    return N.prediction_loss(N.predict(models, test))


@query("n7_best_trial", sql("l2", """with t as (select l2."user" trial, 'ok' status, round(avg(abs(value-u.m)),6) loss from l2 join events on event_id=pos, (select avg(value) m from events) u group by 1)
select trial, loss from t order by loss, trial limit 1"""))
def _(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("pos"), "value")
    df = l2(spark, d).join(ev, "pos").crossJoin(F.broadcast(ev.agg(F.avg("value").alias("m"))))
    t = df.groupBy(F.col("user").alias("trial")).agg(F.round(F.avg(F.abs(F.col("value") - F.col("m"))), 6).alias("loss"))
    t = t.withColumn("status", F.lit("ok"))
    return N.best_trial(t.filter("trial < 'r5'"), t.filter("trial >= 'r5'")).select("trial", "loss")


@query("n8_roll_forward", None)
def _(spark, d):
    models, _, ids = fitted(spark, d)
    log = S.positions(l3(spark, d))
    seqs = log.join(ids.select(F.col("name").alias("task"), F.col("id").cast("int").alias("ac_index")), "task")
    seqs = seqs.select("caseid", (F.col("pos_trace") - 1).alias("idx"), "task", "ac_index")
    return N.roll_forward(seqs, A.case_arrivals(l3(spark, d)), models, 3)
