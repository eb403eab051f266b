"""Decontamination, substring dedup, license scan and SimHash against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseloom.llm import blocks, decontaminate, licenses, simhash, substrings
from caseloom.llm.common import ready
from tests.llm.helpers import DOCS, as_rows, clashing, docs, texts, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def letter_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(autouse=True, scope="module")
def _ready(spark):
    ready(spark)


def plain_contamination(rows, items, span=10):
    windows = defaultdict(set)
    for item, t in items:
        w = letter_words(t)
        for s in range(max(1, len(w) - span + 1)):
            if w:
                windows[tuple(w[s : s + span])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in rows:
        w = letter_words(t)
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                got = windows.get(tuple(w[s : s + k]))
                if got:
                    found |= got
                    hit |= set(range(s, s + k))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def items_of(rows):
    w = letter_words(rows[40][1])
    return [(0, " ".join(w[:25])), (1, " ".join(w[2:12]).upper()), (2, "One two"), (3, "one"), (4, None), (5, " .. "), (1, "c"), (10, " ".join(letter_words(texts()[-2])[500:540])), (11, "one")]


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination(spark):
    rows = list(enumerate(texts())) + [(5, "a b c"), (5, "a b c"), (None, "one two three")]
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = as_rows(decontaminate.find_contamination(clashing(docs(spark, rows)), table), *COLUMNS)
    assert got == plain_contamination(rows, items)


def test_contamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    rows = list(enumerate(texts()))
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(decontaminate.find_contamination(docs(spark, rows), table), *COLUMNS) == plain_contamination(rows, items)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark), none).collect()
    assert len(got) == len(texts()) and not any(r["contaminated"] for r in got)
    assert decontaminate.find_contamination(docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def plain_repeats(rows, span=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in split:
        if d is not None:
            for s in range(len(w) - span + 1):
                key = tuple(w[s : s + span])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for s in range(len(w) - span + 1):
                if least[tuple(w[s : s + span])] < d:
                    gone |= set(range(s, s + span))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_keys", [blocks.RANGE_KEYS, 500, 40])
def test_repeats(spark, range_keys):
    rows = list(enumerate(texts())) + [(3, "one"), (70, texts()[20]), (70, texts()[20]), (None, texts()[30])]
    got = substrings.remove_repeats(clashing(docs(spark, rows)), range_keys=range_keys)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats(rows)


def test_repeats_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    monkeypatch.setattr(substrings.B.in_blocks, "__defaults__", (300,))
    rows = list(enumerate(texts()))
    got = substrings.remove_repeats(docs(spark, rows).repartition(5), range_keys=300)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats(rows)


def test_repeats_keep_columns_and_spacing(spark):
    w = words(5, 40)
    rows = [(1, " ".join(w)), (2, "Clean  text,\n stays\tas it is. "), (3, "begin\n" + "  ".join(w[5:25]) + "\n end"), (4, None), (5, " ".join(w[3:30]))]
    out = substrings.remove_repeats(clashing(docs(spark, rows)), texts=True, counts=("lost_of", "lost"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == rows[1][1] and got[4]["text"] is None
    assert got[3]["text"].split() == ["begin", "end"] and got[3]["lost"] == 20
    assert got[5]["text"] == "" and got[5]["lost"] == got[5]["lost_of"] == 27
    assert got[3]["n_words"] == "clash" and got[3]["block"] == "clash"


def test_repeats_empty(spark):
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def plain_licenses(rows, threshold=0.8):
    import math

    out = []
    for d, t in rows:
        w = letter_words(t)
        base = [(s, label) for p, label in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        labels, score = {label for _, label in base}, float(bool(base))
        for label, template in licenses.TEMPLATES.items():
            t = template.split()
            need = math.ceil(round(threshold * len(set(t)), 9))
            best = max((len(set(w[s : s + len(t)]) & set(t)) for s in range(max(1, len(w) - len(t) + 1))), default=0)
            if best >= need:
                labels.add(label)
                score = max(score, best / len(set(t)))
        at = [s for s, _ in base]
        joined = ",".join(sorted({label for _, label in base})), ",".join(sorted(labels))
        out.append((d, len(w), len(base), min(at, default=None), max(at, default=None), *joined, score))
    return sorted(out, key=repr)


def test_licenses(spark):
    gpl = licenses.TEMPLATES["gpl"].split()
    some = [t for k, t in enumerate(gpl) if k % 7 != 3]
    rows = list(enumerate(texts()[:30])) + [
        (100, "Licensed under the Apache License, Version 2.0. All rights\nreserved. CC-BY cc by"), (101, " ".join(some)),
        (102, " ".join(reversed(gpl))), (103, "released under the MIT"), (104, "x y Released under the MIT License."), (104, "x y Released under the MIT License."),
        (105, "cc cc by"), (106, "license " * 50), (None, "all rights reserved"), (107, " ".join(words(1, 3000)) + " " + " ".join(gpl)),
    ]
    got = licenses.scan_licenses(clashing(docs(spark, rows)))
    assert as_rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == plain_licenses(rows)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def plain_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), seed=42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(fps, ids, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(len(fps)):
        least[find(k)].append(ids[k])
    return [min((i for i in least[find(k)] if i is not None), default=None) for k in range(len(fps))]


def test_simhash(spark):
    rows = list(enumerate(texts())) + [(2, "one"), (2, "one"), (None, "alone in here with four words"), (None, texts()[20])]
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components(fps, [d for d, _ in rows], 4)
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps)), key=repr)
    assert as_rows(simhash.near_duplicates(clashing(docs(spark, rows))), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 3])
def test_near_pairs_lose_nothing(spark, chunk):
    r = random.Random(1)
    fps = []
    for _ in range(60):
        f = r.getrandbits(64)
        fps.append(f)
        for _ in range(r.randint(0, 6)):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    centre = r.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # a dense ball
    fps = sorted(set(fps))
    want = plain_components(fps, list(range(len(fps))), 4)
    rows = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp long")
    links = simhash.near_pairs(rows, 4, chunk).collect()
    at = {np.uint64(f).astype(np.int64).item(): k for k, f in enumerate(fps)}
    assert all((fps[at[x["a"]]] ^ fps[at[x["b"]]]).bit_count() for x in links)
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for x in links:
            a, b = at[x["a"]], at[x["b"]]
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert root == want


def test_every_near_pair_meets_at_an_anchor():
    r = random.Random(5)
    for _ in range(300):
        f = r.getrandbits(64)
        g = f
        for b in r.sample(range(64), r.randint(0, 4)):
            g ^= 1 << b
        place, anchor, home = simhash.anchors_of(np.array([f, g], np.uint64).view(np.int64))
        lives = set(anchor[(place == 0) & (home == 1)].tolist())
        assert lives & set(anchor[(place == 1) & (home == 0)].tolist())


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.one_of_each(docs(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "z y")])).count() == 2 and DOCS


def test_forest_keeps_components():
    a = np.array([5, 6, 7, 1, 9], np.uint64)
    b = np.array([6, 7, 8, 2, 1], np.uint64)
    x, y = simhash.forest(a, b)
    assert Counter(x.tolist()) == Counter({5: 3, 1: 2}) and set(y.tolist()) == {6, 7, 8, 2, 9}


def test_one_of_each_drops_near_duplicates_only(spark):
    """Rows without an id, and rows that share one, are documents of their own."""
    own = [" ".join(words(500 + k, 60)) for k in range(8)]
    near = own[0].split()
    near[30] = "changed"
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (None, own[2]), (5, own[3]), (5, own[4]), (6, own[4]), (7, own[5]), (None, own[5]), (8, own[6]), (8, own[6])]
    rows += [(9, own[7]), (4, own[7]), (9, own[1] + " x")] + ([(None, " ".join(near))] if (plain_fingerprint(own[0]) ^ plain_fingerprint(" ".join(near))).bit_count() <= 4 else [])
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(fps, list(range(len(rows))), 4)
    got = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs(spark, rows)).collect()]
    assert len(got) == len(set(groups))
    for g in set(groups):
        mine = [r for r, c in zip(rows, groups) if c == g]
        kept = [r for r in got if r in mine]
        assert len(kept) == 1 and kept[0][0] == min((d for d, _ in mine if d is not None), default=None)
