"""Process graph: nodes and edges, next tasks through gateways, gateway branches and probabilities.

``nodes(node_id, type, name, element_id)`` and ``edges(src, dst, flow_id)``. Types: start, task, end,
gate (diverging exclusive), gate2 (converging exclusive or inclusive), gate3 (parallel), timer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.rand import exponential, uniform
from caseloom.model import END, START
from caseloom.session import cut, store

STOPS = ["task", "start", "end"]


def raw_model(dfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model elements of a directly-follows graph: an exclusive split after a task with several
    successors, a join before one with several predecessors, and the model's start and end events."""
    names = dfg.select(F.col("a").alias("name")).unionByName(dfg.select(F.col("b").alias("name"))).distinct()
    outs = dfg.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("outs"))
    ins = dfg.groupBy(F.col("b").alias("name")).agg(F.count("*").alias("ins"))
    deg = names.join(outs, "name", "left").join(ins, "name", "left")

    def node(prefix, kind, direction, name=None):
        ident = F.concat(F.lit(prefix), name if name is not None else F.col("name"))
        return F.struct(
            ident.alias("element_id"), F.lit(kind).alias("kind"), (name if name is not None else F.col("name")).alias("name"), F.lit(direction).alias("direction")
        )

    made = deg.select(
        F.explode(
            F.array_compact(
                F.array(
                    node("task:", "task", ""),
                    F.when(F.col("outs") > 1, node("split:", "exclusiveGateway", "Diverging")),
                    F.when(F.col("ins") > 1, node("join:", "exclusiveGateway", "Converging")),
                    F.when(F.col("name") == START, node("event:", "startEvent", "", F.lit("begin"))),
                    F.when(F.col("name") == END, node("event:", "endEvent", "", F.lit("finish"))),
                )
            )
        ).alias("e")
    )
    nodes = made.select("e.*")
    out = F.when(F.col("outs") > 1, F.concat(F.lit("split:"), "name")).otherwise(F.concat(F.lit("task:"), "name"))
    into = F.when(F.col("ins") > 1, F.concat(F.lit("join:"), "name")).otherwise(F.concat(F.lit("task:"), "name"))
    own = deg.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("outs") > 1, F.struct(F.concat(F.lit("task:"), "name").alias("src"), out.alias("dst"))),
                    F.when(F.col("ins") > 1, F.struct(into.alias("src"), F.concat(F.lit("task:"), "name").alias("dst"))),
                    F.when(F.col("name") == START, F.struct(F.lit("event:begin").alias("src"), F.concat(F.lit("task:"), "name").alias("dst"))),
                    F.when(F.col("name") == END, F.struct(F.concat(F.lit("task:"), "name").alias("src"), F.lit("event:finish").alias("dst"))),
                )
            )
        ).alias("e")
    ).select("e.*")
    src = deg.select(F.col("name").alias("a"), out.alias("src"))
    dst = deg.select(F.col("name").alias("b"), into.alias("dst"))
    between = dfg.select("a", "b").join(src, "a").join(dst, "b").select("src", "dst")
    edges = own.unionByName(between)
    return nodes, edges.withColumn("flow_id", F.concat(F.lit("flow:"), "src", F.lit(">"), "dst"))


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classify model elements and drop the flows that touch the model's start and end events."""
    kind, direction = F.col("kind"), F.col("direction")
    typ = (
        F.when((kind == "task") & (F.col("name") == START), "start")
        .when((kind == "task") & (F.col("name") == END), "end")
        .when(kind == "task", "task")
        .when((kind == "exclusiveGateway") & (direction == "Diverging"), "gate")
        .when(kind.isin("exclusiveGateway", "inclusiveGateway"), "gate2")
        .when(kind == "parallelGateway", "gate3")
        .when(kind == "timerEvent", "timer")
    )
    typed = nodes.select(F.col("element_id").alias("node_id"), typ.alias("type"), "name", "element_id")
    events = typed.filter(F.col("type").isNull()).select("node_id")
    kept = edges.join(events.withColumnRenamed("node_id", "src"), "src", "left_anti")
    kept = kept.join(events.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return typed.filter(F.col("type").isNotNull()), kept.select("src", "dst", "flow_id")


def graph_of(dfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of a directly-follows relation. The relation is written out first: the model reads it often."""
    nodes, edges = build_graph(*raw_model(cut(dfg)))
    return store(nodes), store(edges)


def find_flow(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Flow id of each (src, dst)."""
    return pairs.join(edges, ["src", "dst"])


def paths(nodes: DataFrame, edges: DataFrame, origins: DataFrame) -> DataFrame:
    """``(origin, node_id, path)``: tasks reached from each origin through gateways only.

    Breadth first; a gateway is entered once per origin, so gateway cycles end. ``path`` is a shortest
    path (the smallest one on ties), as an array of node ids. The loop is bounded by the longest chain
    of gateways.
    """
    types = nodes.select(F.col("node_id").alias("dst"), "type")
    hop = edges.select("src", "dst").join(types, "dst")
    front = origins.select(F.col("node_id").alias("origin"), F.col("node_id"), F.array("node_id").alias("path"))
    seen = None
    while True:
        nxt = front.join(hop, front["node_id"] == hop["src"]).groupBy("origin", "dst", "type").agg(
            F.min(F.concat("path", F.array("dst"))).alias("path")
        )
        nxt = nxt.withColumnRenamed("dst", "node_id")
        if seen is not None:
            nxt = nxt.join(seen.select("origin", "node_id"), ["origin", "node_id"], "left_anti")
        nxt = cut(nxt)
        seen = nxt if seen is None else seen.unionByName(nxt)
        front = nxt.filter(~F.col("type").isin(STOPS)).select("origin", "node_id", "path")
        if front.limit(1).count() == 0:
            return seen.filter(F.col("type").isin(STOPS)).select("origin", "node_id", "path")


def next_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(a, b, path)`` by name for every task (Start included) and the tasks that can come next."""
    origins = nodes.filter(F.col("type").isin(STOPS)).select("node_id")
    p = paths(nodes, edges, origins)
    name = nodes.select("node_id", "name")
    p = p.join(name.select(F.col("node_id").alias("origin"), F.col("name").alias("a")), "origin")
    return store(p.join(name.select("node_id", F.col("name").alias("b")), "node_id").select("a", "b", "path"))


def entry_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = paths(nodes, edges, nodes.filter(F.col("type") == "start").select("node_id"))
    return p.join(nodes.select("node_id", F.col("name").alias("task")), "node_id").select("task")


def exit_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    p = paths(nodes, back, nodes.filter(F.col("type") == "end").select("node_id"))
    return p.join(nodes.select("node_id", F.col("name").alias("task")), "node_id").select("task")


def out_degrees(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Number of outgoing flows per gateway (parallel ones unless told otherwise)."""
    gates = nodes.filter(F.col("type").isin(types or ["gate3"])).select("node_id", "type")
    return gates.join(edges, gates["node_id"] == edges["src"]).groupBy("node_id", "type").agg(F.count("*").alias("num_paths"))


def gateway_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gate, t_path, t_task)``: for each outgoing path of a diverging gateway the tasks it leads to."""
    gates = nodes.filter(F.col("type") == "gate").select(F.col("node_id").alias("gate"))
    first = gates.join(edges, gates["gate"] == edges["src"]).select("gate", F.col("dst").alias("t_path"))
    types = nodes.select("node_id", "type")
    heads = first.join(types, first["t_path"] == types["node_id"]).select("gate", "t_path", "type")
    direct = heads.filter(F.col("type").isin(STOPS)).select("gate", "t_path", F.col("t_path").alias("t_task"))
    origins = heads.filter(~F.col("type").isin(STOPS)).select(F.col("t_path").alias("node_id")).distinct()
    deeper = paths(nodes, edges, origins).select(F.col("origin").alias("t_path"), F.col("node_id").alias("t_task"))
    return direct.unionByName(heads.select("gate", "t_path").join(deeper, "t_path").select("gate", "t_path", "t_task"))


def _gate_paths(branches: DataFrame) -> DataFrame:
    return branches.select("gate", "t_path").distinct()


def branch_probabilities(branches: DataFrame, executions: DataFrame) -> DataFrame:
    """Share of the gateway's executions (three decimals, 0 if the gateway was never passed)."""
    df = _gate_paths(branches)
    ex = executions.select(F.col("src").alias("gate"), F.col("dst").alias("t_path"), "executions")
    df = df.join(ex, ["gate", "t_path"], "left").withColumn("executions", F.coalesce("executions", F.lit(0)))
    total = F.sum("executions").over(Window.partitionBy("gate"))  # a gateway has at most one path per task
    return df.withColumn("prob", F.coalesce(F.round(F.try_divide("executions", total), 3), F.lit(0.0)))


def equal_probabilities(branches: DataFrame) -> DataFrame:
    return _gate_paths(branches).withColumn("prob", F.round(1 / F.count("*").over(Window.partitionBy("gate")), 2))


def random_probabilities(branches: DataFrame, seed: int = 1) -> DataFrame:
    """A flat Dirichlet draw per gateway (normalised exponentials), two decimals."""
    df = _gate_paths(branches).withColumn("e", exponential(uniform(seed, "gate", "t_path"), 1.0))
    return df.withColumn("prob", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("gate")), 2)).drop("e")


def repair_probabilities(df: DataFrame) -> DataFrame:
    """Make each gateway's probabilities sum to 1.

    The difference goes to the smallest value if it is positive, else to the largest (the first one in
    path order). With two paths a zero becomes 0.01.
    """
    w = Window.partitionBy("gate")
    p = F.nanvl(F.coalesce("prob", F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("p", p)
    df = df.withColumns(
        {
            "diff": F.round(F.round(1 - F.sum("p").over(w), 9), 2),
            "low": F.row_number().over(w.orderBy("p", "t_path")),
            "high": F.row_number().over(w.orderBy(F.desc("p"), "t_path")),
            "k": F.count("*").over(w),
        }
    )
    hit = F.when(F.col("diff") > 0, F.col("low") == 1).otherwise(F.col("high") == 1)
    df = df.withColumn("p", F.round(F.when(hit, F.col("p") + F.col("diff")).otherwise(F.col("p")), 10))
    df = df.withColumn("zero", F.max((F.col("p") == 0).cast("int")).over(w))
    two = (F.col("k") == 2) & (F.col("zero") == 1)
    fixed = F.when(two, F.when(F.col("p") == 0, 0.01).otherwise(0.99)).otherwise(F.col("p"))
    return df.withColumn("prob", fixed).drop("p", "diff", "low", "high", "k", "zero")


