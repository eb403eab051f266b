"""SimHash near-duplicates by anchor points of a covering code.

Each text gets a 64-bit fingerprint. Fingerprints within ``distance`` bits are found through anchors: the 64 bits
are cut into three blocks, so two fingerprints at distance 4 or less differ in one bit at most in some block. Each
block has a covering code: a Hamming code over its first 15 bits (every word lies within one bit of a code word)
with the other bits as they are. A fingerprint lives at the anchor that covers it (radius 1) and visits every
anchor within radius plus threshold (1 + 1), so a pair always meets. Per anchor, residents are compared with visitors.

What an anchor reports is a forest over its linked fingerprints, not all their pairs. Anchors with many residents
are cut into chunks; visitors go to each chunk. Distinct fingerprints are compared, never copies.

Defined results: a null text has no words, so its fingerprint is zero, which links like any other. Repeated rows
give repeated rows. Rows with a null ``doc_id`` get a fingerprint and the smallest id of their component, or null
if it has none. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.components import components
from caseloom.llm.common import fresh, store

BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Residents of an anchor that one task holds.
CHUNK = 2048
#: Pairs that are compared at once.
AT_ONCE = 1 << 20


def fingerprint(text: str | None, k: int = 4) -> int:
    """Majority bits of the XXH64 values (seed 42) of the k-word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist())]
    set_bits = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        some = np.array(hashes[a : a + (1 << 16)], "<u8")
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], "<u8").view("<i8")
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(found)], names=[*rest, "fp"])


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``, with ``key`` between them if given; fp holds the 64 bits as a signed number."""
    keys, kind = ([], "") if key is None else ([key.alias("key")], "key long, ")
    return docs.select(F.col("doc_id").cast("long"), "text", *keys).mapInArrow(_fingerprints, f"doc_id long, {kind}fp long")


def _parity_table() -> np.ndarray:
    """The syndrome of every 15-bit word: the exclusive or of the places (1 to 15) of its ones."""
    words = np.arange(1 << 15)
    out = np.zeros(1 << 15, np.uint8)
    for place in range(15):
        out ^= (((words >> place) & 1) * (place + 1)).astype(np.uint8)
    return out


def _flips(bits: int, most: int) -> np.ndarray:
    out = [0] + [1 << i for i in range(bits)]
    if most > 1:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return np.array(out, np.int64)


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in fp, anchor, resident?) for every anchor that a fingerprint lives at or visits."""
    syndrome = _parity_table()
    place, anchor, resident = [], [], []
    u = fp.view("<u8")
    for number, (at, bits) in enumerate(BLOCKS):
        v = ((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        for flips, home in ((_flips(15, 1), 1), (_flips(bits, 2), 0)):
            for a in range(0, len(v), 4096):
                c = v[a : a + 4096, None] ^ flips[None, :]
                i, j = np.nonzero(syndrome[c & 0x7FFF] == 0)
                place.append(i + a)
                anchor.append(c[i, j] | number << 24)
                resident.append(np.full(len(i), home, np.int8))
    return np.concatenate(place), np.concatenate(anchor), np.concatenate(resident)


def _spread(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        if not len(fp):
            continue
        place, anchor, resident = anchors_of(fp)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(resident), pa.array(fp[place])], names=["anchor", "resident", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as the pairs (a, b)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[child]], nodes[child]


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _compare_tile(homes: np.ndarray, guests: np.ndarray, distance: int):
    """Links of one anchor, a slice of its visitors at a time."""
    step = max(1, AT_ONCE // max(1, len(homes)))
    for a in range(0, len(guests), step):
        some = guests[a : a + step]
        i, j = np.nonzero(_near(homes[:, None], some[None, :], distance))
        x, y = homes[i], some[j]
        apart = x != y
        if apart.any():
            yield forest(x[apart], y[apart])


def compare(distance: int):
    """Rows sorted by (cell, residents first) -> links."""

    def finish(cells, resident, fp):
        """All cells here are complete and small: compare them together."""
        home = resident == 1
        hc, hf, gc, gf = cells[home], fp[home], cells[~home], fp[~home]
        lo, hi = np.searchsorted(gc, hc, "left"), np.searchsorted(gc, hc, "right")
        ends = np.cumsum(hi - lo)
        a = 0
        while a < len(hc):
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
            n = hi[a:b] - lo[a:b]
            x = np.repeat(hf[a:b], n)
            at = np.repeat(lo[a:b] - (ends[a:b] - n - base), n) + np.arange(n.sum())
            y = gf[at]
            ok = _near(x, y, distance) & (x != y)
            if ok.any():
                yield forest(x[ok], y[ok])
            a = b

    def links(batches):
        open_cell, homes = None, None  # a cell whose rows go on in the next batch
        held: list[tuple] = []
        for batch in batches:
            cells, resident, fp = (batch.column(k).to_numpy() for k in range(3))
            if not len(cells):
                continue
            held.append((cells, resident, fp.view("<u8")))
            if sum(len(h[0]) for h in held) < 40_000:
                continue
            cells, resident, fp = (np.concatenate(c) for c in zip(*held))
            held = []
            if open_cell is not None and cells[0] != open_cell:
                open_cell = homes = None
            if open_cell is not None:
                n = int(np.searchsorted(cells, open_cell, "right"))
                own = resident[:n] == 1
                homes = np.concatenate([homes, fp[:n][own]])
                yield from _compare_tile(homes, fp[:n][~own], distance)
                cells, resident, fp = cells[n:], resident[n:], fp[n:]
                if not len(cells):
                    continue
                open_cell = homes = None
            n = int(np.searchsorted(cells, cells[-1], "left"))
            yield from finish(cells[:n], resident[:n], fp[:n])
            if len(cells) - n > CHUNK * 4:  # a long cell: keep its residents, compare what visits
                own = resident[n:] == 1
                open_cell, homes = cells[-1], fp[n:][own]
                yield from _compare_tile(homes, fp[n:][~own], distance)
            else:
                held = [(cells[n:], resident[n:], fp[n:])]
        if held:
            cells, resident, fp = (np.concatenate(c) for c in zip(*held))
            if open_cell is not None:
                n = int(np.searchsorted(cells, open_cell, "right")) if cells[0] == open_cell else 0
                own = resident[:n] == 1
                yield from _compare_tile(np.concatenate([homes, fp[:n][own]]), fp[:n][~own], distance)
                cells, resident, fp = cells[n:], resident[n:], fp[n:]
            if len(cells):
                yield from finish(cells, resident, fp)

    def run(batches):
        for a, b in links(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    return run


def near_pairs(fps: DataFrame, distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``fps(fp)`` -> links ``(a, b)`` that span every group linked within ``distance`` (4 at most)."""
    if not 0 <= distance <= 4:
        raise ValueError("three blocks and radius 1 hold for distances up to 4")
    rows = store(fps.select("fp").mapInArrow(_spread, "anchor long, resident byte, fp long"))
    full = rows.filter("resident = 1").groupBy("anchor").count().filter(F.col("count") > chunk)
    full = full.select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    rows = rows.join(full, "anchor", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    rows = rows.withColumn("part", F.explode(F.when(F.col("resident") == 1, own).otherwise(every)))
    cell = F.xxhash64("anchor", "part")
    rows = rows.select(cell.alias("cell"), "resident", "fp").repartition("cell")
    rows = rows.sortWithinPartitions("cell", F.col("resident").desc())
    return rows.mapInArrow(compare(distance), "a long, b long").distinct()


def _with_least(found: DataFrame, value: Column, distance: int) -> DataFrame:
    """``found(..., fp)`` with ``least``, the smallest ``value`` of each row's component."""
    groups = store(found.groupBy("fp").agg(F.min(value).alias("least")))
    links = store(near_pairs(groups, distance))
    nodes = links.select(F.col("a").alias("id")).union(links.select("b"))
    roots = components(nodes, links)
    member = groups.join(roots, groups["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = store(member)
    least = member.groupBy("root").agg(F.min("least").alias("of_all"))
    member = store(member.join(least, "root").select("fp", F.col("of_all").alias("least")))
    return found.join(member, "fp")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row per row."""
    out = _with_least(store(fingerprints(docs)), F.col("doc_id"), distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of each component: that of the smallest id, rows without an id last; among equal ids that of the smallest row hash.

    Rows are told apart by id and a hash of all columns (maps aside), so ids may repeat or be null. Equal rows are copies: one stays.
    """
    key = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    value = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key")
    rows = _with_least(store(fingerprints(docs, key)), value, distance)
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    rows = store(rows.groupBy("doc_id", "key").agg(F.max(kept).alias("kept"), F.count("*").alias("rows")))
    name, hashed, own = fresh(docs, "lost"), fresh(docs, "lost_key"), fresh(docs, "row_key")
    lost = rows.filter("not kept").select(F.col("doc_id").alias(name), F.col("key").alias(hashed))
    # the list grows with the corpus: the same plan, which does not broadcast it, at every size
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(own) == F.col(hashed))
    out = docs.withColumn(own, key).join(lost.hint("merge"), same, "left_anti")
    repeated = rows.filter("kept and rows > 1").limit(1).count()
    return (out.dropDuplicates(["doc_id", own]) if repeated else out).drop(own)
