"""Log similarity: m1-m10. The even cases of L2 are the log, the odd ones the simulation."""

from pyspark.sql import functions as F

from caseloom.operators import flow as W
from caseloom.operators import metrics as M
from caseloom.operators import shape as S
from checks.base import l2, l3, query, sql

def even():
    return F.col("caseid").cast("int") % 2 == 0


def halves(spark, d):
    log = l2(spark, d)
    return log.filter(even()), log.filter(~even())


def runs(spark, d):
    """The log, and three simulated runs: all odd cases, and those with remainder 1 and 3 of 4."""
    log, sim = halves(spark, d)
    k = F.col("caseid").cast("int") % 4
    run = F.explode(F.array_compact(F.array(F.lit(0), F.when(k == 1, 1), F.when(k == 3, 2))))
    return log, sim.withColumn("run_num", run)


SP = """sp as (select caseid, min(start_ts) st, max(start_ts) en from l2 group by caseid),
lg as (select * from sp where cast(caseid as int) % 2 = 0),
sm as (select 0 run_num, * from sp where cast(caseid as int) % 2 = 1 union all select 1, * from sp where cast(caseid as int) % 4 = 1 union all select 2, * from sp where cast(caseid as int) % 4 = 3)"""
LOGMAE = "lm as (select run_num, abs((epoch_us(max(en))-epoch_us(min(st))) - (select epoch_us(max(en))-epoch_us(min(st)) from lg))/1e6 sim_val from sm group by run_num)"

EMD = """{n}_t as (select -1 run_num, st ts from lg union all select -1, en from lg union all select run_num, st from sm union all select run_num, en from sm),
{n}_g as (select run_num, {g}, epoch_us(ts) t from {n}_t),
{n}_r as (select *, min(t) over w lo, max(t) over w hi, count(*) over w n from {n}_g window w as (partition by run_num, {gk})),
{n}_b as (select run_num, {gk}, n, case when hi>lo then (hi-lo)/1e7 else 0.1 end wd, case when hi>lo then least((t-lo)*10 // (hi-lo), 9) else 5 end b from {n}_r),
{n}_c as (select run_num, {gk}, n, wd, b, count(*) c from {n}_b group by all),
{n}_f as (select run_num, {gk}, n, wd, unnest(range(0,10)) b from (select distinct run_num, {gk}, n, wd from {n}_c) z),
{n}_d as (select run_num, {gk}, list_sort(list(coalesce(c,0)/(n*wd))) dn from {n}_f left join {n}_c using (run_num, {gk}, n, wd, b) group by run_num, {gk}),
{n}_k as (select {gk}, r.run_num, dn from {n}_d, (select distinct run_num from sm) r where {n}_d.run_num=-1),
{n}_s as (select coalesce(a.run_num, b.run_num) run_num, {co},
  case when a.dn is null or b.dn is null then {e} else (select sum(abs(a.dn[i]-b.dn[i]))/10 from (select unnest(range(1,11)) i) q) end score
  from {n}_k a full join (select * from {n}_d where run_num >= 0) b on a.run_num=b.run_num and {on})"""
_G = {
    "hour_emd": ("hour(ts)+1 win", ["win"]),
    "day_emd": ("isodow(ts)-1 wd0", ["wd0"]),
    "day_hour_emd": ("isodow(ts)-1 wd0, hour(ts)+1 win", ["wd0", "win"]),
    "cal_emd": ("cast(ts as date) date", ["date"]),
}


def emd_sql(c, empty=0.0):
    g, k = _G[c]
    return EMD.format(n=c, g=g, gk=", ".join(k), e=empty, co=", ".join(f"coalesce(a.{x}, b.{x}) {x}" for x in k), on=" and ".join(f"a.{x}=b.{x}" for x in k))


@query("m1_log_mae", sql("l2", "with " + SP + ", " + LOGMAE + " select * from lm"))
def _(spark, d):
    log, sims = runs(spark, d)
    return M.log_mae(S.case_spans(log), M.run_spans(sims))


for _c in _G:

    def _emd(spark, d, c=_c):
        log, sims = runs(spark, d)
        return M.emd(M.span_times(S.case_spans(log)), M.span_times(M.run_spans(sims)), c).withColumn("sim_val", F.round("sim_val", 9))

    query(f"m2_{_c}", sql("l2", "with " + SP + ", " + emd_sql(_c) + f" select run_num, round(avg(score),9) sim_val from {_c}_s group by run_num"))(_emd)


@query("m2_day_hour_groups", sql("l2", "with " + SP + ", " + emd_sql("day_hour_emd") + ' select run_num, wd0 weekday, win "window", round(score,9) score from day_hour_emd_s'))
def _(spark, d):
    log, sims = runs(spark, d)
    g = M.emd_groups(M.span_times(S.case_spans(log)), M.span_times(M.run_spans(sims)), "day_hour_emd")
    return g.withColumn("score", F.round("score", 9))


@query("m2s_serie_emd", sql("l3", """with cs as (select caseid, min(start_ts) st from l3 group by 1), sp as (select caseid, st, st en from cs where hour(st) > 3 or day(st) % 2 = 0),
lg as (select caseid, st, null::timestamp en from sp where day(st) % 2 = 0), sm as (select 0 run_num, caseid, st, null::timestamp en from sp where day(st) % 2 = 1),
""" + emd_sql("hour_emd", 1.0).replace(" union all select -1, en from lg", "").replace(" union all select run_num, en from sm", "") + " select run_num, round(avg(score),9) sim_val from hour_emd_s group by run_num"))
def _(spark, d):
    a = l3(spark, d).groupBy("caseid").agg(F.min("start_ts").alias("ts")).filter((F.hour("ts") > 3) | (F.day("ts") % 2 == 0))
    log = a.filter(F.day("ts") % 2 == 0)
    sim = a.filter(F.day("ts") % 2 == 1).withColumn("run_num", F.lit(0))
    return M.emd(log, sim, "hour_emd", empty=1.0).withColumn("sim_val", F.round("sim_val", 9))


VAR3 = """sq as (select caseid, day(min(start_ts)) % 2 side, string_agg(chr(96 + cd::int), '' order by start_ts, pos) s from l3 join (select task, dense_rank() over (order by task) cd from (select distinct task from l3) z) c using (task) group by caseid),
va as (select s, min(caseid) caseid, count(*) cases from sq where side = 0 group by s), vb as (select s, min(caseid) caseid, count(*) cases from sq where side = 1 group by s),
pr as (select va.caseid, vb.caseid o, damerau_levenshtein(va.s, vb.s)/greatest(len(va.s), len(vb.s)) c from va, vb)"""


@query("m3_dl_variants", sql("l3", "with " + VAR3 + " select caseid, round(avg(c),9) mean_cost, round(min(c),9) min_cost, min(o) filter (c = mn) nearest from (select *, min(c) over (partition by caseid) mn from pr) z group by caseid"))
def _(spark, d):
    log = l3(spark, d)
    parity = F.regexp_extract("caseid", "-([0-9]+)$", 1).cast("int") % 2
    a, b, names = M.paired_profiles(log.filter(parity == 0), log.filter(parity == 1))
    out = M.distance_to_all(M.variant_profiles(a), M.variant_profiles(b), names, "dl")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_cost", "min_cost")})


DL2 = """sq as (select caseid, cast(caseid as int) % 2 side, string_agg(chr(96 + cd::int), '' order by start_ts, pos) s, epoch_us(max(start_ts))-epoch_us(min(start_ts)) cyc from l2 join (select task, dense_rank() over (order by task) cd from (select distinct task from l2) z) c using (task) group by caseid),
pr as (select a.caseid, b.caseid o, damerau_levenshtein(a.s, b.s)/greatest(len(a.s), len(b.s)) dl, abs(a.cyc-b.cyc) mae from sq a, sq b where a.side=0 and b.side=1)"""


@query("m3_dl_cases", sql("l2", "with " + DL2 + " select caseid, round(avg(dl),9) mean_cost, round(min(dl),9) min_cost from pr group by caseid"))
def _(spark, d):
    a, b, names = M.paired_profiles(*halves(spark, d))
    out = M.distance_to_all(a, b, names, "dl")
    return out.select("caseid", *[F.round(c, 9).alias(c) for c in ("mean_cost", "min_cost")])


@query("m4_tsd_cases", None)
def _(spark, d):
    log, sim = halves(spark, d)
    a, b, names = M.paired_profiles(log, sim)
    return M.distance_to_all(a, b, names, "tsd", W.footprint(log))


@query("m5_mae_pairs", sql("l2", "with " + SP + """ select a.caseid, round(avg(abs((epoch_us(a.en)-epoch_us(a.st))-(epoch_us(b.en)-epoch_us(b.st)))),3) mean_mae,
 min(abs((epoch_us(a.en)-epoch_us(a.st))-(epoch_us(b.en)-epoch_us(b.st)))) min_mae from lg a, (select * from sm where run_num=0) b group by 1"""))
def _(spark, d):
    log, sim = halves(spark, d)
    return M.mae_to_all(S.case_spans(log), S.case_spans(sim)).withColumn("mean_mae", F.round("mean_mae", 3))


@query("m6_dl_mae_cases", sql("l2", "with " + DL2 + " select caseid, round(avg(0.5*dl+0.5*mae/(select max(mae) from pr)),9) mean_cost, round(min(0.5*dl+0.5*mae/(select max(mae) from pr)),9) min_cost from pr group by caseid"))
def _(spark, d):
    a, b, names = M.paired_profiles(*halves(spark, d))
    out = M.distance_to_all(a, b, names, "dl_mae")
    return out.select("caseid", *[F.round(c, 9).alias(c) for c in ("mean_cost", "min_cost")])


# the shorter side, in order, takes places of the longer one: least cost over all places so far, one value after another
MAE = """cy as (select sm.run_num, 1 k, epoch_us(en)-epoch_us(st) c from sm union all select r.run_num, 0, epoch_us(en)-epoch_us(st) from lg, (select distinct run_num from sm) r),
sd as (select run_num, list_sort(list(c) filter (k = 0)) a, list_sort(list(c) filter (k = 1)) b from cy group by run_num),
ss as (select run_num, case when len(a) <= len(b) then a else b end s, case when len(a) <= len(b) then b else a end l from sd),
mm as (with recursive dp as (select run_num, s, l, 0 i, list_transform(range(len(l) - len(s) + 1), lambda x: 0::bigint) d from ss
  union all select run_num, s, l, i + 1, list_transform(range(1, len(d) + 1), lambda x: list_min(d[1:x]) + abs(l[i + x] - s[i + 1])) from dp where i < len(s))
  select run_num, list_min(d) / len(s) / 1e6 sim_val from dp where i = len(s))"""


@query("m7_mae_match", sql("l2", "with " + SP + ", " + MAE + " select run_num, round(sim_val,6) sim_val from mm"))
def _(spark, d):
    log, sims = runs(spark, d)
    return M.mae_matching(S.case_spans(log), M.run_spans(sims)).withColumn("sim_val", F.round("sim_val", 6))


@query("m7_dl_match", None)
def _(spark, d):
    return M.matched_score(*halves(spark, d), "dl", epsilon=0.01)


@query("m7_tsd_match", None)
def _(spark, d):
    return M.matched_score(*halves(spark, d), "tsd", epsilon=0.02)


ALL = SP + ", " + LOGMAE + ", " + MAE + ", " + ", ".join(emd_sql(c) for c in _G) + """,
res as (select run_num, 'log_mae' metric, sim_val from lm union all select run_num, 'mae', sim_val from mm""" + "".join(
    f" union all select run_num, '{c}', avg(score) from {c}_s group by run_num" for c in _G
) + ")"


@query("m08_run_table", sql("l2", "with " + ALL + " select run_num, metric, round(sim_val,6) sim_val from res where run_num = 0"))
def _(spark, d):
    log, sim = halves(spark, d)
    return M.sql_metrics(log, sim.withColumn("run_num", F.lit(0))).withColumn("sim_val", F.round("sim_val", 6))


@query("m9_many_runs", sql("l2", "with " + ALL + " select run_num, metric, round(sim_val,6) sim_val from res"))
def _(spark, d):
    return M.sql_metrics(*runs(spark, d)).withColumn("sim_val", F.round("sim_val", 6))


@query("m10_result_table", sql("l2", "with " + ALL + " select run_num, " + ", ".join(f"round(max(case when metric='{m}' then sim_val end),6) {m}" for m in ["log_mae", "mae", *_G]) + " from res group by run_num"))
def _(spark, d):
    t = M.result_table(M.sql_metrics(*runs(spark, d)))
    return t.select("run_num", *[F.round(c, 6).alias(c) for c in t.columns if c != "run_num"])
