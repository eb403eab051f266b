"""Hard negatives, language profiles and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import conversations as C
from caseloom.llm import languages, negatives
from caseloom.llm.common import ready, store
from tests.llm.helpers import as_rows, clashing, docs, texts


@pytest.fixture(autouse=True, scope="module")
def _ready(spark):
    ready(spark)


# ---- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int"
PAIR = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vector_rows(seed=5, n=400, every=20):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 8))
    out = []
    for k in range(n):
        v = (centres[k % 12] * r.choice([0.02, 0.3, 1.0]) + r.standard_normal(8) * 0.1).round(3)
        out.append((k, v.tolist(), int(r.integers(0, 4))))
    out += [(every * 50 + k, [0.5] * 8, k % 3) for k in range(60)]  # equal vectors, ties
    out += [out[0], out[every], (every * 90, [0.25] * 8, 1), (every * 90, [0.5] * 8, 1)]  # repeated rows and ids
    out += [(every * 91, None, 1), (every * 92, [1.0, None] * 4, 1), (every * 93, [float("nan")] * 8, 1), (every * 94, [float("inf")] * 8, 1), (every * 95, [0.5] * 8, None)]
    out += [(None, [0.5] * 8, 0), (None, [0.5] * 8, 1), (every * 96, [1.0, 2.0], 0), (every * 96 + 1, [1.0, 2.0], 0), (every * 96 + 2, [0.9, 2.0], 1)]
    out += [(every * 97, [], 0), (3, [], 0), (4, [], 1), (every * 98, [300.0] * 8, 2), (every * 98 + 1, [300.0] * 8, 2), (every * 98 + 2, [280.0] * 8, 3)]
    out += [(-every, [0.5] * 8, 1)]
    return out


def plain_negatives(rows, every):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, lab) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, m) for b, (j, w, m) in enumerate(ok) if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for score, j, _ in [s for s in scored if s[2] == lab][:5]:
            fits = [s for s in scored if s[2] != lab and 80 * score <= 100 * s[0] <= 100 * score]
            out += [(i, j, k + 1, f[1], score, f[0]) for k, f in enumerate(fits[:5])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("TREE", 4), ("STEP", 16), ("CELL_ROWS", 64), ("CELL_ANCHORS", 8)):
            monkeypatch.setattr(negatives, name, value)
    rows = vector_rows()
    df = clashing(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "l")).withColumn("label", F.col("l"))
    df = df.withColumns({c: F.lit("x") for c in ("part", "side", "anchor", "v", "tree", "rank")})
    assert as_rows(negatives.hard_negatives(df, every=20), *PAIR) == plain_negatives(rows, 20)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], VECTORS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(100, None, 1), (200, [1.0], None)], VECTORS)).collect() == []


def test_spanning_tree_is_minimal_and_spares_scores():
    r = np.random.default_rng(1)
    x = (r.standard_normal((6, 16))[r.integers(0, 6, 120)] * 400 + r.standard_normal((120, 16)) * 4).astype(np.int32)
    order, parents, lengths = negatives.spanning_tree(x)
    assert sorted(order) == list(range(120)) and (parents < np.arange(120)).all()
    points = np.vstack([x.astype(float), np.zeros((1, 16))])
    away = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    total, joined, left = 0.0, {120}, set(range(120))  # Prim's algorithm, plainly
    while left:
        a, b = min(itertools.product(joined, left), key=lambda e: away[e])
        total, joined, left = total + away[a, b], joined | {b}, left - {b}
    assert abs(lengths.sum() - total) < 1e-6 * total
    # near anchors: a child rescores few of the candidates
    tree = negatives._Tree(0, 16, *(np.arange(120, dtype="<i8").tobytes(),) * 3, x[order].tobytes(), parents.tobytes(), lengths.tobytes())
    c = (r.standard_normal((500, 16)) * 400).astype(np.int32)
    exact, seen = x[order].astype(int) @ c.T, {}
    least = np.sort(exact, axis=1)[:, -5]
    work = tree.walk(c.astype(float), negatives._norms(c), np.float64, lambda k, lo, hi: hi >= least[k], lambda k, at, s: seen.update({k: dict(zip(at.tolist(), s.tolist()))}))
    assert work < 0.4 * exact.size
    for k in range(120):
        assert seen[k].items() >= {(j, exact[k, j]) for j in np.flatnonzero(exact[k] >= least[k]).tolist()}
        assert all(exact[k, j] == s for j, s in seen[k].items())


# ---- languages


def plain_grams(text):
    out, word = Counter(), []
    for c in (text or "").lower():
        if c.isalpha():
            word.append(c)
        elif not word or word[-1] != " ":
            word.append(" ")
    if not any(c != " " for c in word):
        return out
    s = " " + "".join(word).strip(" ") + " "
    for n in (1, 2, 3):
        out.update(s[k : k + n] for k in range(len(s) - n + 1) if s[k : k + n] != " ")
    return out


def plain_profile(counts, top):
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:top]


def plain_languages(rows, top):
    totals = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            totals[lang] += plain_grams(t)
    ranks = {lang: {g: k for k, g in enumerate(plain_profile(c, top))} for lang, c in totals.items() if c}
    out = []
    for i, t, _ in rows:
        mine = plain_profile(plain_grams(t), top)
        if not mine or not ranks:
            out.append((i, "und", 0.0))
            continue
        away, lang = min((sum(abs(k - r[g]) if g in r else top for k, g in enumerate(mine)), name) for name, r in ranks.items())
        out.append((i, lang, 1 - away / (top * len(mine))))
    return sorted(out, key=repr)


LANGUAGE_TEXTS = {
    "en": "the cat and the dog went to the house with other things that they found there",
    "de": "der Hund und die Katze gingen nicht in das schöne Haus und fanden dort über alles etwas",
    "el": "η γάτα και ο σκύλος πήγαν στο σπίτι με άλλα πράγματα που βρήκαν εκεί",
    "zz": "ÿÿÿ 😀 ÿÿ",
}


def language_rows():
    r, rows = random.Random(2), []
    for k in range(160):
        lang = r.choice(["en", "en", "de", "el"])
        w = LANGUAGE_TEXTS[lang].split()
        rows.append((k, " ".join(r.choice(w) for _ in range(r.randint(1, 40))) + r.choice(["", ". ", "\n3 x\t"]), lang if k % 5 else None))
    rows += [(200 + k, t, "en") for k, t in enumerate(["", " \n", "123 !?", None, "Ünïcode İ ǅ", "a", "a" * 5000])]
    return rows + [rows[0], rows[1], (None, "der die das", "de"), (300, LANGUAGE_TEXTS["zz"], "zz"), (301, "zz", "nothing"), (302, "1 2", "empty")]


@pytest.mark.parametrize("small", [False, True])
def test_languages(spark, monkeypatch, small):
    top = 20 if small else languages.TOP
    if small:
        for name, value in (("CHUNK", 2), ("PIECE", 7), ("HELD", 50), ("PENDING", 100)):
            monkeypatch.setattr(languages, name, value)
    rows = language_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = df.withColumns({c: F.lit("x") for c in ("lang_pred", "gram", "n", "place")})
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = store(languages.learn_profiles(df, ~held, top))
    got = as_rows(languages.identify(df, profiles, ["doc_id"], top), "doc_id", "lang_pred", "score")
    want = plain_languages(rows, top)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)


def test_languages_without_rows_or_labels(spark):
    from caseloom.llm.queries import op12_languages  # noqa: F401  (registered)

    df = docs(spark, [(1, "some text"), (5, None)]).withColumn("lang", F.lit(None).cast("string"))
    profiles = store(languages.learn_profiles(df, F.lit(True)))
    assert as_rows(languages.identify(df, profiles, ["doc_id"]), "doc_id", "lang_pred", "score") == [(1, "und", 0.0), (5, "und", 0.0)]
    assert languages.identify(docs(spark, []), profiles, ["doc_id"]).collect() == []


def test_pieces_count_like_the_whole(monkeypatch):
    for t in texts():
        whole = languages.ngrams(t)
        for piece in (1, 2, 5, 64):
            monkeypatch.setattr(languages, "PIECE", piece)
            if t and len(t) > 3000 and piece < 64:
                continue
            assert all((a == b).all() for a, b in zip(whole, languages.ngrams(t)))


@pytest.mark.parametrize("limits", [{}, {"GROUP": 40}, {"GROUP_TEXTS": 1}, {"DENSE": 10}])
def test_texts_are_counted_together(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(languages, name, value)
    monkeypatch.setattr(languages, "ngrams", None)  # for long texts only
    rows = [(t, lang) for _, t, lang in language_rows() if lang] + [("ΑΣ ΣΑΣ", "el"), ("\0a\0 b", "en"), ("中文 字符", "zz")]
    batch = pa.RecordBatch.from_pydict({"lang": [lang for _, lang in rows], "text": [t for t, _ in rows]})
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    got, want = Counter(), Counter()
    for out in languages._count_grams([batch]):
        for r in out.to_pylist():
            got[r["lang"], r["gram"]] += r["n"]
    for t, lang in rows:
        for g, n in plain_grams(t).items():
            want[lang, number(g)] += n
    assert got == want
    top = 30
    places = [{"lang": a, "gram": b, "place": k} for a in sorted({a for a, _ in want}) for k, (_, b) in enumerate(sorted((-n, b) for (x, b), n in want.items() if x == a)[:top])]
    texts = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "p": ["und"] * len(rows), "s": [0.0] * len(rows)})
    answers = [(r["p"], r["s"]) for out in languages._predict(languages.Profiles(places, top), 0, 1, 2)([texts]) for r in out.to_pylist()]
    plain = plain_languages([(None, t, lang) for t, lang in rows], top)
    assert sorted(answers, key=repr) == sorted([(lang, s) for _, lang, s in plain], key=repr)


def test_held_out_accuracy(spark):
    from caseloom.llm.queries import op12_languages

    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op12_languages(spark, d).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)


# ---- conversations

ROWS = "conv_id long, turn long, role string, text string"
OUT = [f.split()[0] for f in C.OUT.split(", ")]


def plain_parse(rows):
    """(cost, audit, standing texts): all ways, by states of what has been said so far."""
    import re

    legal = lambda s: re.fullmatch("(s?(ua)*u?|)", s)  # noqa: E731  (a beginning of what the grammar allows)
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    ways = {("", ()): (0, "")}

    def better(new, key, value):
        if legal(key[0]) and (key not in new or value < new[key]):
            new[key] = value
            return True

    def inserted(ways):
        out = dict(ways)
        for _ in range(2):  # more in a row would be dearer than to delete what stands
            for (s, t), (c, a) in list(out.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    better(out, (s + x, (*t, name + ":")), (c + 5, a + "I"))
        return out

    ways = inserted(ways)
    for (_, role, text), f in zip(rows, faults):
        new = {}
        for (s, t), (c, a) in ways.items():
            better(new, (s, t), (c + 2, a + "D"))
            if f in ("b", "d"):
                continue
            extra = 5 if f else 0
            better(new, (s + (role[:1] or " "), (*t, f"{role}:{text}")), (c + extra, a + "K"))
            for x, name in (("u", "user"), ("a", "assistant")):
                better(new, (s + x, (*t, f"{name}:{text}")), (c + extra + 1, a + "R"))
        ways = inserted(new)
    cost, audit, said = min((c, a, t) for (s, t), (c, a) in ways.items() if re.fullmatch("(s?(ua)+)?", s))
    return cost, audit, said, faults


def plain_repair(rows, damaged=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        mine = by[conv]
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if k == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, said, faults = plain_parse(mine)
        turns = [t for t, _, _ in mine if t is not None]
        roles = [r[:1] or " " for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = Counter(faults)
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows(n=60, seed=8):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randint(0, 4)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"])
            text = r.choice(["Hello.", "Why?", "cut of", "", " \n", "Done! ", "ß ü.", None, f"unique {conv} {turn}."])
            rows.append((conv, r.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), (900, 1, "user", "x."), (900, 1, "user", "x."), (900, 1, "assistant", "y")]
    return rows + [(901, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(5)]


@pytest.mark.parametrize("damaged", [True, False])
@pytest.mark.parametrize("long_rows", [C.LONG_ROWS, 2, 1])
def test_conversations(spark, monkeypatch, long_rows, damaged):
    monkeypatch.setattr(C, "LONG_ROWS", long_rows)
    rows = conversation_rows()
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("times", "kind", "long", "chunk", "place", "n", "salt")})
    got = C.repair_conversations(C.damage(df) if damaged else C.intact(df))
    assert as_rows(got, *OUT) == plain_repair(rows, damaged)


def test_a_long_text_is_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(C, "LONG_BYTES", 40)
    rows = conversation_rows(30, 3)
    assert as_rows(C.repair_conversations(C.damage(spark.createDataFrame(rows, ROWS))), *OUT) == plain_repair(rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """The chunks of a long conversation give what one pass gives."""
    r = random.Random(4)
    rows = [(7, k, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "No!", f"cut {k}", f"Said {k}.", ""])) for k in range(700)]
    whole = as_rows(C.repair_conversations(C.damage(spark.createDataFrame(rows, ROWS))), *OUT)
    monkeypatch.setattr(C, "LONG_ROWS", 23)
    assert as_rows(C.repair_conversations(C.damage(spark.createDataFrame(rows, ROWS))), *OUT) == whole


def test_no_conversations(spark):
    empty = spark.createDataFrame([], ROWS)
    assert C.repair_conversations(C.damage(empty)).collect() == []
    # a dropped row leaves its conversation: crc32("2:0") % 20 == 0 would be one; find some
    conv, turn = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = C.repair_conversations(C.damage(spark.createDataFrame([(conv, turn, "user", "x.")], ROWS)))
    assert as_rows(got, *OUT) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
