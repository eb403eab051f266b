"""Readers and writers on small files."""

import gzip
import zipfile

import pytest

from caseloom.sources import logs as L
from caseloom.sources import models as MD
from caseloom.sources import tables as TB

CSV = "Case ID,Activity,Resource,Start Timestamp,Complete Timestamp\n1,Start,x,2024-01-01T00:00:00,2024-01-01T00:00:00\n1,A,u,2024-01-01T01:00:00,2024-01-01T02:00:00+02:00\n"
XES = """<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/"><trace><string key="concept:name" value="c1"/>
<event><string key="concept:name" value="A &amp; B"/><string key="lifecycle:transition" value="start"/><string key="org:resource" value="u"/><date key="time:timestamp" value="2024-01-01T01:00:00.5+02:00"/></event>
<event><string key="concept:name" value="end"/><string key="lifecycle:transition" value="start"/><date key="time:timestamp" value="2024-01-01T01:00:00"/></event>
<event><string key="concept:name" value="A &amp; B"/><string key="lifecycle:transition" value="schedule"/><date key="time:timestamp" value="2024-01-01T01:00:00"/></event>
</trace></log>"""
BPMN = """<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL"><process id="p"><startEvent id="s" name="s"/><task id="t1" name="Start"/><task id="t2" name="A"/>
<exclusiveGateway id="g" name="" gatewayDirection="Diverging"/><parallelGateway id="p3" name=""/><endEvent id="e" name="e"/>
<sequenceFlow id="f0" sourceRef="s" targetRef="t1"/><sequenceFlow id="f1" sourceRef="t1" targetRef="g"/><sequenceFlow id="f2" sourceRef="g" targetRef="t2"/></process></definitions>"""


def write(path, text):
    path.write_text(text)
    return str(path)


def check(df):
    (r,) = df.collect()
    assert (r["caseid"], r["task"], r["user"], r["start_ts"].hour, r["end_ts"].hour) == ("1", "A", "u", 1, 2)


def test_csv(spark, tmp_path):
    check(L.read_log(spark, write(tmp_path / "a.csv", CSV)))


def test_gzip(spark, tmp_path):
    path = tmp_path / "a.csv.gz"
    path.write_bytes(gzip.compress(CSV.encode()))
    check(L.read_log(spark, str(path)))


def test_zip(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", CSV)
        z.writestr("note.txt", "no log")
    check(L.read_log(spark, str(path)))


def test_zip_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "b.zip"
    head, *rows = CSV.strip().split("\n")
    turned = "\n".join(",".join(reversed(line.split(","))) for line in [head + ",Cost", *[r + ",7" for r in rows]])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", turned)
    check(L.read_log(spark, str(path)))


def test_xes_source(spark, tmp_path):
    event = '<event><string key="concept:name" value="A"/><string key="lifecycle:transition" value="start"/><string key="elementId" value="%s_1"/><date key="time:timestamp" value="2024-01-01T01:00:00"/></event>'
    body = "<trace><string key=\"concept:name\" value=\"c\"/>" + event % "Task" + event % "Gateway" + "</trace></log>"
    simulated = write(tmp_path / "s.xes", f'<log><string key="source" value="{L.SIMULATOR_SOURCE}"/>{body}')
    other = write(tmp_path / "o.xes", f'<log><string key="name" value="x"/>{body}')
    assert L.read_log(spark, simulated).count() == 1 and L.read_log(spark, other).count() == 2
    assert L.read_log(spark, other, source=L.SIMULATOR_SOURCE).count() == 1


def test_reuse_needs_a_complete_table(spark, tmp_path):
    from caseloom.sources import sinks

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert sinks.reuse(spark, path, lambda: spark.range(5)).count() == 5
    assert sinks.reuse(spark, path, lambda: spark.range(9)).count() == 5


def test_unknown_extension(spark):
    with pytest.raises(IOError):
        L.read_log(spark, "a.doc")


def test_xes(spark, tmp_path):
    (r,) = L.read_log(spark, write(tmp_path / "a.xes", XES)).collect()
    assert (r["caseid"], r["task"], r["user"], r["transition"], r["ts"].hour, r["ts"].microsecond) == ("c1", "A & B", "u", "start", 1, 500000)


def test_bpmn(spark, tmp_path):
    from caseloom.operators.graph import build_graph

    nodes, edges = build_graph(*MD.read_bpmn(spark, write(tmp_path / "m.bpmn", BPMN)))
    assert {r["node_id"]: r["type"] for r in nodes.collect()} == {"t1": "start", "t2": "task", "g": "gate", "p3": "gate3"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("t1", "g"), ("g", "t2")}


def test_alignment_file(spark, tmp_path):
    path = write(tmp_path / "al.csv", "h1\nh2\nh3\n7, x, LMGOOD(A), MINVI(tau), MREAL( B ), L(C)\n")
    got = [(r["trace_type"], r["m"], r["move"], r["task"]) for r in TB.parse_moves(TB.read_data_lines(spark, path)).orderBy("m").collect()]
    assert got == [("7", 0, "LMGOOD", "A"), ("7", 2, "MREAL", "B"), ("7", 3, "L", "C")]


def test_embedding_check(spark, tmp_path):
    v = TB.read_embedding(spark, write(tmp_path / "a.emb", "1, A, 0.5, -1.5\n2, B, 1, 2\n"))
    tasks = spark.createDataFrame([("A",), ("C",)], "task string")
    assert {(r["name"], r["side"]) for r in TB.embedding_mismatch(v, tasks).collect()} == {("B", "embedding"), ("C", "log")}
    with pytest.raises(ValueError):
        TB.checked_embedding(v, tasks)


def test_a_repeated_xes_attribute(spark, tmp_path):
    twice = '<string key="concept:name" value="old"/><string key="concept:name" value="A"/><string key="lifecycle:transition" value="start"/>'
    event = f'<event>{twice}<date key="time:timestamp" value="2023-01-01T01:00:00"/><date key="time:timestamp" value="2024-01-01T01:00:00"/></event>'
    path = write(tmp_path / "d.xes", f'<log><trace><string key="concept:name" value="x"/><string key="concept:name" value="c"/>{event}</trace></log>')
    (r,) = L.read_log(spark, path).collect()
    assert (r["caseid"], r["task"], r["ts"].year) == ("c", "A", 2024)
