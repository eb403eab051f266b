"""Balanced label propagation: linked documents move to one shard while shard sizes stay even.

Documents are linked through groups (hubs): all documents of a hub attract each other. They begin on hashed shards. The members of each
hub are counted per shard; in a round each open hub asks for the shard that holds most of its members, of those that have room
for all of it. Requests are granted under quotas: a shard takes the larger hubs first, and of hubs of one size those that win
most, as far as its room goes. Who is refused asks the next shard in the next round. The room a shard keeps is less than its smallest refusal, so
it at least halves per round; the rounds end when no request can be granted.

Hubs larger than a shard (fewer than there are shards) fill whole shards first, and their rest goes where it fits best. Hubs that find no room
at the end (fewer than there are shards as well, by the sum of the rooms) get it by exchanges of smaller hubs between two shards; what no exchange
helps is spread over the roomiest shards. Documents follow their hubs in one join, and documents without a hub fill what is left,
so row counts are at most one apart.

Only counts per shard and small size, and the few hubs named above, reach the driver. A hub of any size is counted with partial aggregates; its
members are never gathered.

Defined results: a null text has size 1 and crc 0 and links with nothing; empty texts are a group like any other. Repeated
rows are placed once each. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import numbered, store

#: Hubs up to this size take part in exchanges.
SMALL = 64


def _asked(hubs: DataFrame, room: list[int]) -> DataFrame:
    """``hubs(hub, n, held)`` with the best shard that has room for the whole hub (``want``, null if none has) and its members there."""
    liked = F.transform(
        F.sequence(F.lit(0), F.lit(len(room) - 1)),
        lambda j: F.struct(F.coalesce(F.element_at("held", j), F.lit(0)).alias("here"), F.xxhash64("hub", j).alias("tie"), j.alias("shard")),
    )
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    best = F.array_max(F.filter(liked, lambda s: F.element_at(rooms, s["shard"] + 1) >= F.col("n")))
    return hubs.withColumn("best", best).select("hub", "n", "held", F.col("best.shard").alias("want"), F.col("best.here").alias("here"))


def _granted(asked: DataFrame, room: list[int]) -> DataFrame:
    """The requests that fit: ``(hub, n, shard)``."""
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    larger = Window.partitionBy("want").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = asked.groupBy("want", "n").agg(F.count("*").alias("many"))
    left = F.element_at(rooms, F.col("want") + 1) - F.coalesce(F.sum(F.col("n") * F.col("many")).over(larger), F.lit(0))
    sizes = sizes.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("many"), F.floor(left / F.col("n")))))
    sizes = store(sizes.filter("quota > 0"))
    whole = asked.join(sizes.filter("quota = many").select("want", "n"), ["want", "n"])
    part = asked.join(sizes.filter("quota < many").select("want", "n", "quota"), ["want", "n"])  # one size per shard at most
    part = part.withColumn("loss", F.least(F.col("n") - F.col("here"), F.lit(16)))
    part = numbered(store(part.drop("held", "here")), ["want", "n"], ["loss"], "_rank").filter("_rank < quota")
    return whole.select("hub", "n", F.col("want").alias("shard")).unionByName(part.select("hub", "n", F.col("want").alias("shard")))


def fill_whole(sizes: dict, room: list[int]) -> dict:
    """Shards for hubs larger than a shard: ``hub -> [(shard, rows)]``; changes ``room``."""
    out: dict = {h: [] for h in sizes}
    rest = dict(sizes)
    empty = set(range(len(room)))
    for h in sorted(sizes, key=lambda h: (-sizes[h], h)):
        # room differs by one at most: so many larger shards that nothing is left, if that can be
        least = min((room[s] for s in empty), default=0)
        more = rest[h] % least if least else 0
        larger = sorted(s for s in empty if room[s] > least)[:more]
        exact = larger + sorted(s for s in empty if room[s] == least)[: rest[h] // least - more] if least and more <= rest[h] // least else []
        choice = exact if sum(room[s] for s in exact) == rest[h] else sorted(empty, key=lambda s: (-room[s], s))
        for s in choice:
            if rest[h] >= room[s] > 0:
                out[h].append((s, room[s]))
                rest[h] -= room[s]
                room[s] = 0
                empty.discard(s)
    for h in sorted(rest, key=lambda h: (-rest[h], h)):
        fits = [s for s in range(len(room)) if room[s] >= rest[h] > 0]
        if fits:
            s = min(fits, key=lambda s: (room[s], s))
            out[h].append((s, rest[h]))
            room[s] -= rest[h]
        else:
            out[h] += spread(rest[h], room)
    return out


def spread(n: int, room: list[int]) -> list[tuple[int, int]]:
    """``n`` rows over the roomiest shards; changes ``room``."""
    out = []
    while n:
        s = max(range(len(room)), key=lambda s: (room[s], -s))
        take = min(n, room[s])
        out.append((s, take))
        room[s] -= take
        n -= take
    return out


def make_room(need: int, room: list[int], held: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int, int]]] | None:
    """A shard with room for ``need`` rows after moves ``(from, size, to)`` of single hubs; changes ``room`` and ``held`` if there is one.

    A move gives a hub of a shard to another that has the room, for a smaller one of that shard or none. ``held`` counts the hubs that have
    not moved, by (shard, size). A shard that lacks more than ``SMALL`` rows per shard is not tried.
    """
    for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
        if need - room[s] > SMALL * len(room):
            break
        r, h, moves = list(room), Counter(held), []
        others = [o for o in range(len(room)) if o != s]
        while r[s] < need:
            steps = [
                (t, x, o)
                for o in others
                for t in range(1, min(r[o], need - r[s], SMALL) + 1)
                for x in range(SMALL - t + 1)
                if h[s, x + t] and (not x or h[o, x])
            ]
            if not steps:
                break
            t, x, o = max(steps, key=lambda q: (q[0], -q[1], -q[2]))
            for source, size, to in ((s, x + t, o), (o, x, s)):
                if size:
                    h[source, size] -= 1
                    moves.append((source, size, to))
            r[s] += t
            r[o] -= t
        if r[s] >= need:
            room[:] = r
            held.clear()
            held.update(h)
            return s, moves
    return None


def _between(rank: str, bounds: list[tuple[int, int]]) -> Column:
    """The shard of a rank: the first ``n`` of each ``(shard, n)`` in turn."""
    upto, out = sum(n for _, n in bounds), F.lit(None).cast("int")
    for s, n in reversed(bounds):
        out = F.when(F.col(rank) < upto, F.lit(s)).otherwise(out)
        upto -= n
    return out


def balanced_shards(rows: DataFrame, shards: int = 8) -> DataFrame:
    """``rows(..., hub)`` with a shard for each row: sizes in rows are at most one apart.

    ``hub`` names the group a row belongs to; rows with a null hub are free. ``rows`` is read several times.
    """
    spark, columns = rows.sparkSession, rows.columns
    linked, free = rows.filter("hub is not null"), rows.filter("hub is null")
    start = F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int")
    votes = linked.groupBy("hub", start.alias("shard")).agg(F.count("*").alias("here"))
    hubs = store(votes.groupBy("hub").agg(F.sum("here").alias("n"), F.map_from_entries(F.collect_list(F.struct("shard", "here"))).alias("held")))
    alone = free.count()
    total = alone + (hubs.agg(F.sum("n")).first()[0] or 0)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    large = {r["hub"]: r["n"] for r in hubs.filter(F.col("n") > total // shards).select("hub", "n").collect()}  # fewer than shards
    split = fill_whole(large, room)
    open_, given, lost = hubs.filter(F.col("n") <= total // shards), None, {}
    while True:
        asked = store(_asked(open_, room))
        lost |= {r["hub"]: r["n"] for r in asked.filter("want is null").select("hub", "n").collect()}  # fewer than shards in the end
        asked = asked.filter("want is not null")
        won = store(_granted(asked, room))
        taken = won.groupBy("shard").agg(F.sum("n").alias("n")).collect()
        if not taken:
            break
        for r in taken:
            room[r["shard"]] -= r["n"]
        given = won if given is None else given.unionByName(won)
        open_ = store(asked.join(won.select("hub"), "hub", "left_anti").select("hub", "n", "held"))
    moves: list[tuple[int, int, int]] = []
    if lost:
        cells = given.filter(F.col("n") <= SMALL).groupBy("shard", "n").count().collect() if given is not None else []
        held = {(r["shard"], r["n"]): r["count"] for r in cells}
        for hub in sorted(lost, key=lambda h: (-lost[h], h)):
            got = make_room(lost[hub], room, held)
            if got:
                room[got[0]] -= lost[hub]
                split[hub] = [(got[0], lost[hub])]
                moves += got[1]
            else:
                split[hub] = spread(lost[hub], room)
    if moves:
        ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (source, size, to), many in sorted(Counter(moves).items()):
            ways.setdefault((source, size), []).append((to, many))
        table = [(s, n, [{"to": to, "many": many} for to, many in w]) for (s, n), w in ways.items()]
        some = spark.createDataFrame(table, "shard int, n long, ways array<struct<to: int, many: int>>")
        some = some.select("shard", "n", F.flatten(F.transform("ways", lambda w: F.array_repeat(w["to"], w["many"]))).alias("to"))
        mine = numbered(store(given.join(F.broadcast(some.select("shard", "n")), ["shard", "n"])), ["shard", "n"], [], "_rank")
        mine = mine.join(F.broadcast(some), ["shard", "n"]).filter(F.col("_rank") < F.size("to"))
        mine = store(mine.select("hub", F.element_at("to", (F.col("_rank") + 1).cast("int")).alias("to")))
        given = given.join(mine, "hub", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    out = numbered(free, [], [], "_rank").withColumn("shard", _between("_rank", list(enumerate(room)))).select(*columns, "shard")
    if given is not None:
        out = out.unionByName(linked.join(given.select("hub", "shard"), "hub").select(*columns, "shard"))
    if split:
        ranked = numbered(linked.filter(F.col("hub").isin(list(split))), ["hub"], [], "_rank")
        place = F.lit(None).cast("int")
        for hub, bounds in split.items():
            place = F.when(F.col("hub") == hub, _between("_rank", bounds)).otherwise(place)
        out = out.unionByName(ranked.withColumn("shard", place).select(*columns, "shard"))
    return store(out)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``; equal texts attract."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.sha2(data, 256)).alias("hub"))
    rows = store(rows)
    again = store(rows.groupBy("hub").count().filter("count > 1 and hub is not null").select(F.col("hub").alias("h")))
    rows = rows.join(again, F.col("hub") == F.col("h"), "left").withColumn("hub", F.col("h")).drop("h")
    placed = balanced_shards(store(rows), shards)
    placed = numbered(placed.drop("hub"), ["shard"], [], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
