"""Repeated passages, by prefix-partitioned suffix trees.

A suffix is a document from some word on. Only its first ``span`` words matter here: two suffixes that agree on them
meet in an internal node of depth ``span`` or more. The trees are kept in the form of hashed labels: a node is known by the
hash of the words on its path.

1. Count: every block sends the hashes of its windows (suffixes cut at depth ``span``), 32 bits within a range of
   hashes. Suffixes whose hash occurs in one document only end here; a chance match costs work, not exactness.
2. Partition: the others go to the tree of their prefix. Prefixes have variable length: ``PREFIXES[0]`` words, and for
   prefixes so frequent that their tree would not fit in a task, more words. A tree's leaves under one prefix are told
   apart by the full path (prefix hash of 38 bits or more and a further 64 bits), which is exact for practical purposes.
3. Trees: each task builds the trees of its prefixes by sorting. Nodes at full depth with leaves from more than one
   document are the maximal repeats' inner nodes; the answer to each leaf is whether a smaller document id hangs there.
4. Removal: each block covers the words of the windows that were found and cuts them out.

A passage that a third of all documents share is one leaf per block.

Defined results: a null or empty text has no words. A window counts only within one document. Rows with a null
``doc_id`` lose nothing and are no source for others. Rows that repeat an id are one document, as no id is
smaller. Documents shorter than ``span`` keep all. An empty table gives no rows. Further columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import blocks as B
from caseloom.llm.common import store

#: Lengths of prefixes that name a tree, in words.
PREFIXES = (4, 8)
NO_ID = np.iinfo(np.int64).max
_SENT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("ids", pa.binary())])
SENT = "block long, part int, keys binary, more binary, ids binary"
_HEAVY = -1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _multipliers(span: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, span]).integers(0, 1 << 63, span, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of a block's documents."""

    def __init__(self, ids, texts: list, span: int):
        self.words = [(t or "").encode().split() for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        known = _Hashes()
        get = known.__getitem__
        self.symbols = np.fromiter((h for w in self.words for h in map(get, w)), np.uint64, int(self.sizes.sum()))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        ok = (self.sizes >= span) & np.array([i is not None for i in ids], bool)
        counts = np.where(ok, self.sizes - span + 1, 0)
        self.doc = np.repeat(np.arange(len(self.sizes)), counts)
        base = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.at = np.arange(int(counts.sum())) - np.repeat(base - self.first[:-1], counts)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)[self.doc]
        self.span = span

    def hashes(self, depth: int, seed: int) -> np.ndarray:
        """Hash of the first ``depth`` words of each window."""
        out = np.zeros(len(self.at), np.uint64)
        for j, m in enumerate(_multipliers(depth, seed)):
            out += self.symbols[self.at + j] * m
        return _mixed(out)


def _distinct(keys: np.ndarray, ids: np.ndarray):
    """(sorted distinct keys, place of each row among them, smallest id, whether further ids occur)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    if not len(k):
        return k, place, ids, np.empty(0, bool)
    low = np.minimum.reduceat(ids[order], starts)
    high = np.maximum.reduceat(ids[order], starts)
    return k[starts], place, low, low != high


def _low_bits(keys: np.ndarray, n: int) -> np.ndarray:
    """32 bits of each key below those that name its range."""
    return ((keys << np.uint64(n.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)


def _windows_of(table: pa.Table, span: int) -> Windows:
    return Windows(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), span)


def _count(span: int, n: int, heavy: int):
    def run(key, table):
        block = key[0].as_py()
        w = _windows_of(table, span)
        keys, _, _, more = _distinct(w.hashes(span, 1), w.ids)
        cuts = B.range_cuts(keys, n)
        rows = []
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                rows.append((block, p, B.pack_sorted(_low_bits(keys[a:b], n)), B.pack_bits(more[a:b]), None))
        prefix, often = np.unique(w.hashes(PREFIXES[0], 2), return_counts=True)
        some = often >= heavy
        rows.append((block, _HEAVY, B.pack(prefix[some]), B.pack(often[some].astype(np.int64)), None))
        return B.batch_of(_SENT, rows)

    return run


def _repeated(key, table):
    """Of each block's hashes in a range: does another document have it?"""
    sent = [B.unpack_sorted(x, "u4") for x in table.column("keys").to_pylist()]
    more = [B.unpack_bits(x, len(s)) for x, s in zip(table.column("more").to_pylist(), sent)]
    sizes = [len(s) for s in sent]
    values, place, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    twice = count > 1
    twice[place[np.concatenate(more)]] = True
    # equal low bits inside one block are two hashes of one range: they count as two, which costs work only
    found = np.split(twice[place], np.cumsum(sizes)[:-1])
    rows = [(b, key[0].as_py(), B.pack_bits(f), None, None) for b, f in zip(table.column("block").to_pylist(), found)]
    return B.batch_of(_SENT, rows)


def _survivors(w: Windows, answers: pa.Table, n: int) -> np.ndarray:
    """Which windows may occur in another document."""
    keys, place, _, _ = _distinct(w.hashes(w.span, 1), w.ids)
    cuts = B.range_cuts(keys, n)
    alive = np.zeros(len(keys), bool)
    for p, data in zip(answers.column("part").to_pylist(), answers.column("keys").to_pylist()):
        alive[cuts[p] : cuts[p + 1]] = B.unpack_bits(data, int(cuts[p + 1] - cuts[p]))
    return alive[place]


class _Leaves:
    """A block's distinct surviving suffixes, sorted by the hash of their prefix."""

    def __init__(self, w: Windows, alive: np.ndarray, heavy: np.ndarray):
        self.alive = np.flatnonzero(alive)
        prefix = w.hashes(PREFIXES[0], 2)[self.alive]
        if len(heavy):
            longer = np.isin(prefix, heavy)
            prefix[longer] = w.hashes(PREFIXES[1], 3)[self.alive][longer]
        path = w.hashes(w.span, 1)[self.alive]
        order = np.lexsort((path, prefix))
        p, q = prefix[order], path[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(p) else np.empty(0, bool)
        self.starts = np.flatnonzero(new)
        self.place = np.empty(len(p), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.ids = w.ids[self.alive]
        self.prefix, self.path = p[self.starts], q[self.starts]
        self.low = np.minimum.reduceat(self.ids[order], self.starts) if len(p) else np.empty(0, np.int64)


def _send_leaves(span: int, n: int, trees: int, heavy: np.ndarray):
    def run(key, table, answers):
        if not table.num_rows:
            return B.batch_of(_SENT, [])
        block = table.column("block")[0].as_py()
        w = _windows_of(table, span)
        leaves = _Leaves(w, _survivors(w, answers, n), heavy)
        cuts = B.range_cuts(leaves.prefix, trees)
        rows = []
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                low = _low_bits(leaves.prefix[a:b], trees)
                rows.append((block, p, B.pack_sorted(low), B.pack(leaves.path[a:b]), B.pack(leaves.low[a:b])))
        return B.batch_of(_SENT, rows)

    return run


def _grow_trees(key, table):
    """Sort a range's suffixes; at each full-depth node, tell the leaves whether a smaller id hangs there too."""
    prefix = [B.unpack_sorted(x, "u4") for x in table.column("keys").to_pylist()]
    sizes = [len(p) for p in prefix]
    path = np.concatenate([B.unpack(x, "u8") for x in table.column("more").to_pylist()])
    ids = np.concatenate([B.unpack(x, "i8") for x in table.column("ids").to_pylist()])
    prefix = np.concatenate(prefix)
    order = np.lexsort((path, prefix))
    p, q = prefix[order], path[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    node = np.empty(len(p), np.int64)
    node[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = least[node] < ids
    found = np.split(smaller, np.cumsum(sizes)[:-1])
    rows = [(b, key[0].as_py(), B.pack_bits(f), None, None) for b, f in zip(table.column("block").to_pylist(), found)]
    return B.batch_of(_SENT, rows)


def covered_words(w: Windows, alive: np.ndarray, leaves: _Leaves, smaller: np.ndarray) -> np.ndarray:
    """Which words of the block lie in a window that also starts in a document with a smaller id."""
    hit = smaller[leaves.place] | (leaves.ids > leaves.low[leaves.place])
    at = w.at[leaves.alive[hit]]
    edge = np.zeros(len(w.symbols) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + w.span, -1)
    return np.cumsum(edge)[:-1] > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the words marked, and without the space before each of them (after it, at the beginning)."""
    out, data, at = [], text.encode(), 0
    place = 0
    for word, lost in zip(data.split(), gone.tolist()):
        begin = data.index(word, place)
        place = begin + len(word)
        if lost:
            out.append(b"")
        else:
            out.append(data[at:begin] + word if at or not out else data[begin:place])
        at = place
    return b"".join(out).decode() + (data[at:].decode() if not len(gone) or not gone[-1] else "")


def _remove(span: int, n: int, trees: int, heavy: np.ndarray, texts: bool):
    digest = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(key, table, answers):
        if not table.num_rows:
            none = pa.array([], pa.int64())
            return table.drop_columns("block").append_column("n_words", none).append_column("n_removed", none) if texts else B.batch_of(digest, [])
        w = _windows_of(table, span)
        step = answers.column("step").to_numpy() if answers.num_rows else np.empty(0)
        alive = _survivors(w, answers.filter(pa.array(step == 1)), n)
        leaves = _Leaves(w, alive, heavy)
        cuts = B.range_cuts(leaves.prefix, trees)
        smaller = np.zeros(len(leaves.prefix), bool)
        told = answers.filter(pa.array(step == 2))
        for p, data in zip(told.column("part").to_pylist(), told.column("keys").to_pylist()):
            smaller[cuts[p] : cuts[p + 1]] = B.unpack_bits(data, int(cuts[p + 1] - cuts[p]))
        gone = covered_words(w, alive, leaves, smaller)
        lost = [gone[a:b] for a, b in zip(w.first, w.first[1:])]
        n_lost = [int(x.sum()) for x in lost]
        if texts:
            kept = [cut_text(t, x) if k else t for t, x, k in zip(table.column("text").to_pylist(), lost, n_lost)]
            at = table.schema.get_field_index("text")
            table = table.set_column(at, table.schema.field(at), pa.array(kept, table.schema.field(at).type)).drop_columns("block")
            table = table.append_column("n_words", pa.array(w.sizes)).append_column("n_removed", pa.array(n_lost, pa.int64()))
            return table
        rows = []
        for k, (doc, words) in enumerate(zip(table.column("doc_id").to_pylist(), w.words)):
            kept = [x for x, l in zip(words, lost[k].tolist()) if not l] if n_lost[k] else words
            rows.append((doc, len(words), n_lost[k], hashlib.sha256(b" ".join(kept)).hexdigest()))
        return B.batch_of(digest, rows)

    return run


def remove_repeats(
    docs: DataFrame, span: int = 13, texts: bool = False, counts: tuple[str, str] = ("n_words", "n_removed"), range_keys: int = B.RANGE_KEYS
) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept_sha256)``, one row per row.

    With ``texts`` the result is ``docs`` itself, with what is left in ``text``, and the columns named by ``counts``.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if texts else []
    rows = docs.select(
        F.col("doc_id").cast("long"), *[docs[f"`{c}`"].alias(f"other_{k}") for k, c in enumerate(others)], F.col("text").cast("string")
    )
    schema = rows.select(F.lit(0).cast("long").alias("block"), "*").schema
    table = B.bucketed(rows.mapInArrow(B.in_blocks(len(rows.columns) - 1), schema))
    by_block = table.groupBy("block")
    size = table.agg(F.sum(F.octet_length("text")), F.count_distinct("block")).first()
    words = (size[0] or 0) // 6  # for the number of ranges only
    n = B.ranges(words, range_keys)
    blocks = max(1, size[1])
    sent = store(by_block.applyInArrow(_count(span, n, max(2, range_keys // (4 * blocks))), SENT))
    lists = sent.filter(F.col("part") == _HEAVY).select("keys", "more").mapInArrow(_heavy_rows, "prefix long, often long")
    heavy = lists.groupBy("prefix").agg(F.sum("often").alias("often")).filter(F.col("often") >= range_keys // 4)
    # at most 4 * words / range_keys prefixes reach that
    heavy = np.array([r["prefix"] for r in heavy.collect()], np.int64).view(np.uint64)
    first = store(sent.filter(F.col("part") >= 0).groupBy("part").applyInArrow(_repeated, SENT))
    leaves = store(by_block.cogroup(first.groupBy("block")).applyInArrow(_send_leaves(span, n, n, heavy), SENT))
    second = store(leaves.groupBy("part").applyInArrow(_grow_trees, SENT))
    answers = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    if texts:
        out = rows.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    else:
        out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    done = by_block.cogroup(answers.groupBy("block")).applyInArrow(_remove(span, n, n, heavy, texts), out)
    if not texts:
        return done
    back = {"doc_id": "doc_id", "text": "text"} | {c: f"other_{k}" for k, c in enumerate(others)}
    return done.select(*[F.col(back[c]).alias(c) for c in docs.columns], *[F.col(a).alias(b) for a, b in zip(("n_words", "n_removed"), counts)])


def _heavy_rows(batches):
    for batch in batches:
        for keys, often in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            k = B.unpack(keys, "u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(B.unpack(often, "i8"))], names=["prefix", "often"])
