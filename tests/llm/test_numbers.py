"""Vectors, archives, shards, packing, language model, classifier and pipeline."""

import base64
import glob
import gzip
import hashlib
import json
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import crf, packing, sharding, suffix_lm, vectors, warc
from caseloom.llm.common import numbered, ready, scratch
from caseloom.llm.queries import vocabulary_path
from tests.llm.helpers import as_rows, clashing, docs, texts, words
from tests.llm.test_texts import plain_components, plain_contamination, plain_fingerprint, plain_repeats


@pytest.fixture(autouse=True, scope="module")
def _ready(spark):
    ready(spark)


# ---- vectors


def vector_rows():
    r = np.random.default_rng(4)
    out, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = r.standard_normal(16)
            for _ in range(int(r.integers(1, 6))):
                out.append((n, (centre + r.standard_normal(16) * 0.03).tolist(), label))
                n += 1
    centre = r.standard_normal(16)
    out += [(n + k, (centre + r.standard_normal(16) * 0.05).tolist(), 5) for k in range(150)]  # a dense group
    n += 150
    out += [(n + k, [1.0] * 16, 6) for k in range(40)]  # equal vectors
    out += [(n + 50, None, 0), (n + 51, [0.0] * 16, 0), (n + 52, [], 0), (n + 53, [1.0, None] * 8, 0), (n + 54, [float("nan")] * 16, 0),
            (n + 55, [float("inf")] * 16, 0), (n + 56, [1e300] * 16, 6), (n + 57, [1.0, 2.0], 6), (n + 58, [1.0, 2.0], 6)]
    return out


def plain_links(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.sqrt((v * v).sum())

    units = [unit(v) for _, v, _ in rows]
    linked = defaultdict(set)
    for i, (a, _, la) in enumerate(rows):
        for j in range(i):
            if la is not None and la == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                linked[i].add(j)
                linked[j].add(i)
    seen = {}
    for i in range(len(rows)):
        todo, comp = [i], {i}
        while todo:
            for k in linked[todo.pop()] - comp:
                comp.add(k)
                todo.append(k)
        seen[i] = min(rows[k][0] for k in comp)
    return sorted((rows[i][0], len(linked[i]), seen[i], rows[i][0] == seen[i]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [vectors.TILE, 32])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df.withColumns({c: F.lit(1) for c in ("component", "v", "size", "id", "tiles")}))
    assert as_rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(plain_links(rows), key=repr)


def test_vectors_empty_and_repeated(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == [(0, 0, None), (1, 1, 1), (1, 1, 1)]
    # rows that share an id have links of their own
    rows = [(k, [1.0, 0.01 * k], 0) for k in range(4)] + [(1, [0.0, 1.0], 0), (4, [0.0, 0.0], 0), (4, [1.0, 0.0], 0), (0, None, 0), (2, [1.0, 0.0], None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, kind))
    assert as_rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(plain_links(rows), key=repr)


# ---- archives


def page_rows():
    return [(3, "http://a/", "<p>x</p>"), (1, "http://b/ y\r\nz", "<p>x</p>"), (2, None, None), (4, "http://c/", ""), (5, "http://d/", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"),
            (6, "http://e/", "z" * 300_000), (7, "u", "<p>x</p>"), (7, "u", "<p>x</p>"), (8, "http://d/", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(spark, least):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("size", F.lit(1))
    manifest = warc.write_warc(df, scratch(spark, "t"), revisit_bytes=least, archive_bytes=2000)
    rows = warc.read_warc(manifest)
    rows = rows.withColumns({"page": warc.page_id(F.col("record_id")), "to": warc.page_id(F.col("refers_to"))}).collect()
    assert not any(r["problem"] for r in rows) and len(rows) == 9
    first = {}
    for p, _, html in page_rows():
        first[html or ""] = min(p, first.get(html or "", p))
    want = []
    for p, _, html in page_rows():
        data = (html or "").encode()
        again = len(data) >= least and first[html or ""] != p
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None, None if again else data))
    got = [(r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # any gzip reader sees the same bytes, one member per record
    for m in manifest.collect():
        raw = b"".join(r["value"] for r in spark.read.format("binaryFile").load(m["path"]).selectExpr("content value").collect())
        assert gzip.decompress(raw).count(b"WARC-Type: ") == m["records"] == len(list(warc.members([raw])))


def test_damaged_archives():
    good = warc._member(warc.record_bytes(1, "u", b"payload", 7, base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, "d"))
    whole = list(warc.members([good[:10], good[10:] + good]))
    assert [p for _, _, p in whole] == [None, None] and whole[1][0] == len(good)
    assert warc.parse_record(whole[0][1])["problem"] is None
    assert list(warc.members([good + good[:20]]))[-1][2] == "the archive ends inside a member"
    assert "not a gzip member" in list(warc.members([b"nonsense" * 9]))[0][2]
    data = whole[0][1]
    assert warc.parse_record(data.replace(b"payload", b"paylord"))["problem"] == "block digest differs"
    assert warc.parse_record(data[:-1])["problem"] and warc.parse_record(b"x")["problem"]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(df, scratch(spark, "t"))).count() == 0


# ---- shards


def test_numbered_is_gapless(spark):
    df = spark.createDataFrame([(k % 3, k // 50) for k in range(700)], "a int, c int")
    got = numbered(df, ["a"], ["c"], "n", per_bucket=50).collect()
    for a in range(3):
        mine = sorted((r["n"], r["c"]) for r in got if r["a"] == a)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [c for _, c in mine] == sorted(c for _, c in mine)


@pytest.mark.parametrize("hot", [0, 200])
def test_shards(spark, hot):
    r = random.Random(2)
    rows = list(enumerate(texts()))
    for k in range(60):
        rows += [(1000 + k * 10 + j, f"group {k} of copies") for j in range(r.randint(2, 6))]
    rows += [(5000 + k, f"alone {k}") for k in range(250)] + [(9000 + k, "hot") for k in range(hot)] + [(7000, "twice"), (7000, "twice"), (None, "no id")]
    got = sharding.shard_documents(clashing(docs(spark, rows))).collect()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes = Counter(x["shard"] for x in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sizes[s]))
    text_of = {d: t for d, t in rows if d is not None}
    where = defaultdict(Counter)
    for x in got:
        if text_of.get(x["doc_id"]) is not None:
            where[text_of[x["doc_id"]]][x["shard"]] += 1
    split = [t for t, c in where.items() if len(c) > 1 and t != "hot"]
    assert not split
    if hot:  # larger than a shard: it fills whole ones
        assert len(where["hot"]) == math.ceil(hot / max(sizes.values()))


def test_shards_without_free_rows(spark):
    rows = [(k, f"pair {k // 2}") for k in range(200)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    sizes = Counter(x["shard"] for x in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_hot_group_and_whole_small_groups_without_free_rows(spark):
    """Half of the rows are one text, the rest groups of two to six: nothing is cut but what its size cuts."""
    r = random.Random(4)
    groups = [r.randint(2, 6) for _ in range(601)]
    rows = [(10_000 + k * 10 + j, f"group {k}") for k, n in enumerate(groups) for j in range(n)]
    rows += [(k, "hot") for k in range(len(rows))]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    sizes = Counter(x["shard"] for x in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    where = defaultdict(set)
    for x in got:
        where[x["doc_id"] // 10 if x["doc_id"] >= 10_000 else -1].add(x["shard"])
    assert sum(len(v) > 1 for k, v in where.items() if k >= 0) == 0
    assert len(where[-1]) <= 5


def test_exchanges_make_room():
    room, held = [1, 1, 0], {(0, 2): 3, (1, 3): 3, (2, 5): 1}
    s, moves = sharding.make_room(2, room, held)
    assert room[s] == 2 and sum(room) == 2 and len(moves) == 2
    assert sharding.make_room(3, [1, 1], {(0, 9): 1}) is None
    room = [10, 10, 10, 10]
    assert sharding.fill_whole({"a": 20, "b": 12}, room) == {"a": [(0, 10), (1, 10)], "b": [(2, 10), (3, 2)]}
    assert room == [0, 0, 0, 8]


def test_numbers_of_equal_rows(spark):
    """Half of the rows are equal: no bucket is crowded and the numbers have no gaps."""
    df = spark.range(4000).selectExpr("if(id % 2 = 0, -1, id) id")
    got = numbered(df, [], [], "n", per_bucket=100)
    assert sorted(x["n"] for x in got.collect()) == list(range(4000))


# ---- packing


def test_best_two_fit():
    r = np.random.default_rng(1)
    for room in (10, 100):
        for _ in range(20):
            lengths = r.integers(1, room + 1, int(r.integers(1, 300)))
            bins = packing.best_two_fit(lengths, room)
            assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
            assert all(lengths[b].sum() <= room for b in bins)
            assert len(bins) <= 1.25 * math.ceil(lengths.sum() / room) + 1
    # 6 + 3 leaves 1; instead of the 3, the twos fill the gap
    lengths = [6, 3, 2, 2]
    assert [sorted(lengths[k] for k in b) for b in packing.best_two_fit(np.array(lengths), 10)] == [[2, 2, 6], [3]]


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = list(enumerate(texts())) + [(3, "one"), (None, "x <|endoftext|> y"), (900, "İstanbul ΑΣ ẞ ﬁ   \x1c á 你好 <|startoftext|>"), (901, "a" * 5000)]
    got = packing.pack(clashing(docs(spark, rows)), vocabulary_path(), length=64).collect()
    t = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[d, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 64) * 1.03 + 1
    assert packing.pack(docs(spark, []), vocabulary_path()).count() == 0


def vocabulary():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return f.read()


def test_packing_characters():
    """Ids are those of the tokenizer for any character below U+0180 in any company, and for others among them."""
    from tokenizers import Tokenizer

    low = [chr(c) for c in range(0x180)]
    r = random.Random(3)
    rows = [x for c in low for x in (c, f"a{c}b", f"A{c}'S{c}{c}1{c}", f"1{c}2 {c}. {c}É")]
    rows += ["".join(r.choices(low + ["'", " ", "<|", "\u0301", "\u2019", "Σ", "你", "\u2028"], k=r.randint(1, 12))) for _ in range(5000)]
    rows += ["I'LL they've 'start x--'s <|endoftext|> <|", " \t", "", None, "\x85\xa0", "a\xa0b\x1cc"]
    t = Tokenizer.from_str(vocabulary())
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in rows]
    encode = packing.Encoder(vocabulary())
    assert encode(pa.array(rows, pa.string())) == want
    assert [encode(pa.array([x], pa.string()))[0] for x in rows] == want  # now from memory
    assert encode(pa.array([], pa.string())) == [] and encode(pa.array([None, ""], pa.string())) == [b"", b""]


def test_packing_other_steps():
    """A tokenizer that prepares texts in another way gets whole chunks."""
    from tokenizers import Tokenizer

    steps = json.loads(vocabulary())
    steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"
    rows = ["ab12 x's, Ab12.", "12 é3", ""]
    t = Tokenizer.from_str(json.dumps(steps))
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in rows]
    assert packing.Encoder(json.dumps(steps))(pa.array(rows)) == want


def test_packing_meets_words_once(monkeypatch):
    """A word in other case or beside other marks costs no further call of the tokenizer."""
    encode = packing.Encoder(vocabulary())
    first, again = encode(pa.array(["lorem ipsum , . ( ) dolor", "(Lorem, IPSUM) dolor."]))
    monkeypatch.setattr(encode, "_encode_words", None)
    monkeypatch.setattr(encode, "_encode_each", None)
    assert encode(pa.array(["Dolor, (ipsum) LOREM.", "(lorem, ipsum) Dolor."]))[1] == again
    assert len(first) and set(encode.words) == {"lorem", "ipsum", "dolor", ",", ".", "(", ")"}


@pytest.mark.parametrize("name", ["STRETCH", "REMEMBERED", "REMEMBERED_WORDS"])
def test_packing_small_memory(monkeypatch, name):
    rows = texts() + [None, ""]
    want = packing.Encoder(vocabulary())(pa.array(rows, pa.string()))
    monkeypatch.setattr(packing, name, 50)
    encode = packing.Encoder(vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])
    run = packing.pieces_of(SimpleNamespace(value=encode), 1 << 30, 1)
    got = [x for out in run([batch.slice(0, 0), batch, batch.slice(3)]) for x in out.to_pylist()]
    end = np.array([1], "<u4").tobytes()
    assert [(x["doc_id"], x["ids_crc32"]) for x in got] == [(k, zlib.crc32(want[k] + end)) for k in [*range(len(rows)), *range(3, len(rows))]]


# ---- language model


def lm_rows():
    r = random.Random(8)
    rows = []
    for k in range(300):
        w = []
        while len(w) < 40:
            w += r.choice([["a", "b", "c", "d"], ["a", "x", "c", "e"], [r.choice("pqrstu")]])
        rows.append((k, " ".join(w).upper() if k % 5 == 0 else "\t".join(w)))
    return rows + [(1000, None), (1001, ""), (None, "a b"), (1002, " ".join(words(3, 5000))), (7, "a b c"), (7, "a b c")]


@pytest.mark.parametrize("keys", [suffix_lm.B.RANGE_KEYS, 60])
def test_suffix_tree(spark, keys):
    rows = lm_rows()
    got = suffix_lm.score_texts(clashing(docs(spark, rows).repartition(3)), share=0.002, range_keys=keys).collect()
    seqs = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [s for d, s in seqs if not held(d)]
    c = Counter(x for s in train for x in s)
    n, v = sum(c.values()), len(c)
    least = max(suffix_lm.LEAST, 0.002 * n)
    root = lambda x: (c[x] + 1) / (n + v + 1)
    follow = defaultdict(Counter)
    for s in train:
        full = [None, *s]
        for i in range(1, len(full)):
            for k in range(1, min(3, i) + 1):
                follow[tuple(full[i - k : i])][full[i]] += 1
    states: dict = {}

    def chance(context, x):
        p = root(x)
        for k in range(1, len(context) + 1):
            s = tuple(context[len(context) - k :])
            if s in states:
                p = (follow[s][x] + states[s] * p) / (sum(follow[s].values()) + states[s])
        return p

    counts_of = lambda s: c[s[0]] if len(s) == 1 else follow[s[:-1]][s[-1]]
    for k in (1, 2, 3):
        for s in [s for s in follow if len(s) == k and counts_of(s) >= least]:
            total = counts_of(s)
            gains = [sum(m * math.log((m - 1 + g * chance(s[1:], x)) / (total - 1 + g) / chance(s[1:], x)) for x, m in follow[s].items()) for g in suffix_lm.STRENGTHS]
            if max(gains) / total >= suffix_lm.GAIN:
                states[s] = suffix_lm.STRENGTHS[int(np.argmax(gains))]
    assert len(states) > 5 and any(len(s) > 1 for s in states)
    want = []
    for d, s in seqs:
        full = [None, *s]
        score = sum(math.log10(chance(tuple(full[max(0, i - 3) : i]), full[i])) for i in range(1, len(full)))
        want.append((d, held(d), len(s), sum(c[x] > 0 for x in s), n, sum(math.log10(root(x)) for x in s), score))
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    have = sorted(([r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")] for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == list(b[:5])
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-6)
    held_rows = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows) * 0.9


def test_suffix_tree_chances_sum_to_one_or_less():
    level = suffix_lm.Level(np.array([5, 3], np.uint64), np.array([10, 20]))
    assert level.contexts.tolist() == [3, 5] and level.counts.tolist() == [20, 10]


def test_suffix_tree_empty(spark):
    assert suffix_lm.score_texts(docs(spark, [])).count() == 0
    only_held = next(k for k in range(100) if suffix_lm.is_held_out(k))
    got = suffix_lm.score_texts(docs(spark, [(only_held, "a b")])).first()
    assert got["train_tokens"] == 0 and got["n_known"] == 0 and got["base_score"] == 0


def test_suffix_tree_leaves_no_shuffles(spark):
    """When the model is learned, the disk holds the blocks and the answers, not what all levels sent."""
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(8000)]
    weights = [1 / (k + 5) for k in range(8000)]
    rows = [(k, " ".join(r.choices(vocabulary, weights, k=250))) for k in range(2000)]
    size = sum(len(t) for _, t in rows)
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f: os.path.getsize(f) for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data") if os.path.exists(f)}

    before = shuffled()
    scored = suffix_lm.score_texts(docs(spark, rows).repartition(4))
    for _ in range(50):
        left = sum(n for f, n in shuffled().items() if f not in before)
        if left < size / 20:
            break
        time.sleep(0.2)
    assert left < size / 20
    assert scored.count() == len(rows)


def test_numbers_of_words_tell_their_counts():
    counts = {0: [9, 4, 4, 1, 0], 3: [7, 4, 1, 1], 1: [9, 0]}  # of ranges' words, by falling count
    sums = [np.unique(c, return_counts=True) for c in counts.values()]
    numbers = suffix_lm.Numbers(list(counts), [v[::-1] for v, _ in sums], [n[::-1] for _, n in sums])
    of = {p: numbers.of(p, np.arange(len(c))) for p, c in counts.items()}
    assert sorted(x for n in of.values() for x in n) == list(range(11)) and numbers.distinct == 9
    model = suffix_lm.Model(40, numbers, 1, 8)
    for p, c in counts.items():
        assert model.count(of[p]).tolist() == c
    assert suffix_lm.Numbers([], [], []).distinct == 0


def test_lists_of_pairs_are_as_they_were_sent():
    columns = [np.array([0, 255, 3]), np.array([256, 0, 65_535]), np.array([0, 1 << 16, 1 << 31]), np.array([1 << 40, 0, 7]), np.zeros(3, np.int64)]
    assert [x.tolist() for x in suffix_lm._unframe(suffix_lm._frame(columns))] == [x.tolist() for x in columns]
    many = [np.arange(300) % 5, np.full(300, 2)]
    assert len(suffix_lm._frame(many)) < 120


# ---- classifier


def test_marginals_against_all_labellings():
    r = np.random.default_rng(3)
    node, pair = r.standard_normal((2, 5)), r.standard_normal((2, 2))
    there = np.array([[True] * 5, [True] * 3 + [False] * 2])
    bad, moves = crf.marginals(node, there, pair)
    want = np.zeros((2, 2))
    for k, n in ((0, 5), (1, 3)):
        z, p = 0.0, np.zeros(n)
        m = np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> t & 1 for t in range(n)]
            w = math.exp(sum(node[k, t] * y[t] for t in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            z += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                m[a, b] += w
        assert bad[k, :n] == pytest.approx(p / z)
        want += m / z
    assert moves == pytest.approx(want) and not bad[1, 3:].any()


def test_line_features():
    x, sizes = crf.line_features("ABC de\n\n1|%% %%\nw w w w\nABC de")
    assert sizes.tolist() == [6, 0, 7, 7, 6]
    assert x[0, 1] == pytest.approx(3 / 6) and x[0, 3] == pytest.approx(1 / 6) and not x[1, :7].any()
    assert x[2, 2] == pytest.approx(1 / 7) and x[2, 5] == pytest.approx(4 / 7) and x[2, 6] == pytest.approx(1 / 7)
    assert x[3, 10] == pytest.approx(3 / 4) and x[4, 11] == 1
    assert len(crf.line_features(None)[0]) == len(crf.line_features("")[0]) == 0


def quality_rows():
    r = random.Random(5)
    rows, labels = [], []
    for k in range(240):
        w = words(k, 60)
        lines = [" ".join(w[a : a + 10]) for a in range(0, 60, 10)]
        good = r.random() < 0.7
        if not good:
            lines[2:5] = ["%%% ".join(x.split()) + "###" for x in lines[2:5]]
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(good)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    known = spark.createDataFrame(labels + [(0, labels[0][1]), (None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    table = clashing(docs(spark, rows + [(500, None), (501, ""), (None, "text"), (502, "x" * 200_000), (7, rows[7][1])]))
    field = crf.train_quality(table, known, ~crf.held_out(F.col("doc_id"), 5, 0))
    got = crf.score_quality(table, field, ["doc_id"]).collect()
    assert len(got) == 245 and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    held = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 20 and all((score[d] >= 0.3) == bool(q) for d, q in held)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = crf.train_quality(docs(spark), none, F.lit(True))
    assert {r["score"] for r in crf.score_quality(docs(spark), field, ["doc_id"]).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    field = crf.train_quality(docs(spark), one, F.lit(True))
    assert {r["score"] for r in crf.score_quality(docs(spark), field, ["doc_id"]).collect()} == {1.0}
    assert crf.score_quality(docs(spark, []), field, ["doc_id"]).count() == 0


# ---- pipeline


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rows, labels = quality_rows()
    base = len(rows)
    in_lines = lambda w: "\n".join(" ".join(w[a : a + 10]) for a in range(0, len(w), 10))
    shared = in_lines(words(4242, 60))
    item = " ".join(words(777, 25))
    rows += [(base + k, t) for k, t in enumerate(texts())]
    rows += [(2000, in_lines(words(61, 30)) + "\n" + shared), (2001, in_lines(words(62, 30)) + "\n" + shared)]
    rows += [(2002, in_lines([*words(63, 17), *item.split(), *words(64, 18)]))]
    d = str(tmp_path)
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).collect()

    table = spark.read.parquet(f"{d}/documents.parquet")
    field = crf.train_quality(table, spark.read.parquet(f"{d}/labels.parquet"), F.lit(True))
    kept = [(i, t) for (i, t), s in zip(rows, field.scores([crf.line_features(t) for _, t in rows])) if s >= 0.3]
    bad = {i for i, q in labels if not q}
    assert not bad & {i for i, _ in kept} and {i for i, q in labels if q} <= {i for i, _ in kept}
    comps = plain_components([plain_fingerprint(t) for _, t in kept], [i for i, _ in kept], 4)
    kept = [(i, t) for (i, t), c in zip(kept, comps) if i == c]
    removed = {r[0]: r for r in plain_repeats(kept)}
    after = []
    for i, t in kept:
        _, n, lost, digest = removed[i]
        if lost and lost == n:
            continue
        if lost:
            left = corpus_pipeline_words(t, kept, i)
            assert hashlib.sha256(" ".join(left).encode()).hexdigest() == digest
            t = " ".join(left)
        after.append((i, t))
    dirty = {r[0] for r in plain_contamination(after, [(1, item)]) if r[5]}
    assert 2002 in dirty
    after = [(i, t) for i, t in after if i not in dirty]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for i, t in after:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want


def corpus_pipeline_words(text, rows, own, span=13):
    """What is left of one document, word by word."""
    least = {}
    for i, t in rows:
        w = (t or "").split()
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            least[key] = min(least.get(key, i), i)
    w = text.split()
    gone = {s + j for s in range(len(w) - span + 1) if least[tuple(w[s : s + span])] < own for j in range(span)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_stages_carry_odd_columns(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "not in any text at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    table = clashing(docs(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, d)
        assert out.columns == table.columns and out.dtypes == table.dtypes
        out.count()
        empty = stage(spark, table.limit(0), d)
        assert empty.count() == 0


# ---- nothing is left out


def test_suffix_tree_keeps_contexts_of_a_large_corpus(spark):
    """A context of 10 occurrences counts in a corpus of 600,000 tokens as in a small one."""
    r = random.Random(6)
    rare = [(k, "zeta eta theta iota") for k in range(12)]
    many = [(100 + k, " ".join(f"v{r.randrange(3000)}" for _ in range(6000))) for k in range(117)]
    train = [k for k, _ in rare if not suffix_lm.is_held_out(k)]
    assert len(train) >= suffix_lm.LEAST
    for rows in (rare, rare + many):
        got = {x["doc_id"]: x for x in suffix_lm.score_texts(docs(spark, rows)).collect()}
        assert (got[0]["train_tokens"] > 500_000) == (rows is not rare)
        assert got[train[0]]["score"] > -2.8 if rows is rare else got[train[0]]["score"] > got[train[0]]["base_score"] / 2


def test_vectors_of_a_large_label(spark):
    """Lone pairs just above the threshold, against all pairs by brute force; a small window stands for a larger label."""
    r = np.random.default_rng(11)
    x = r.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.standard_normal((400, 32))
    side -= (side * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[400:800] = 0.932 * x[:400] + math.sqrt(1 - 0.932**2) * side
    want = np.concatenate([(x[a : a + 2000] @ x.T >= 0.93).sum(axis=1) - 1 for a in range(0, len(x), 2000)])
    assert want.sum() >= 800
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g["n_links"] for g in vectors.near_vectors(df, window=4).collect()}
    missed = sum(int(want[k]) - got[k] for k in range(len(x))) // 2
    assert missed == 0
    assert vectors.passes_for(10_000_000, 0.93) > vectors.passes_for(100_000, 0.93) > vectors.PASSES
