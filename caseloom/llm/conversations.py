"""Conversation structure repair by generalised LR with error actions.

The roles of a conversation must read ``(s?(ua)+)?`` by their initials: a system turn may stand first, then user and assistant take
turns. The grammar's LR table (below) is driven over the turns with weighted actions: keep, give another role, delete, insert. All stacks
reached so far are kept as a graph: tops share what lies below them, and tops in the same state are merged into the one of least
(cost, audit), where the audit lists the initials of the edits. Two audits of one place never are one the prefix of the other
at equal cost (they differ by insertions, which cost), so merging early keeps the least audit of the whole.

Before, each row has at most one fault, the first that applies: blank (nothing but white space), duplicate (role and text
seen earlier in the conversation), truncated (does not end in ``.``, ``!`` or ``?``). Blank rows and duplicates must be deleted; keeping a
truncated row costs extra.

Conversations are read in order of turn (nulls first; equal turns by role, then text) from sorted partitions, one in memory at a
time. One of more than ``LONG_ROWS`` rows or ``LONG_BYTES`` bytes is cut: its rows are sorted over all tasks by range and cut into chunks; first
occurrences come from an aggregation; each chunk gives, for each LR state before it, the least (cost, audit) of each state after it;
these are joined in order, and the chunks' repaired texts follow each other into the digest. Only that last part is
sequential, as SHA-256 is: a task streams the repaired chunks of a conversation and holds one.

Defined results: null roles, texts and, in the damage's key, null ids and turns count as one space. A null id is a conversation of its own. An
empty role has no place in the grammar. A conversation without rows after the damage has zeros, an empty audit and the digest of
an empty text. Repeated rows are rows. An empty table gives no rows. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import parts, store

LONG_ROWS = 4096
LONG_BYTES = 8 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\v\f\r"

# LR table of  S -> P | s P | (nothing),  P -> u a | P u a
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 6, (4, "u"): 6, (2, "a"): 5, (6, "a"): 7}
POPS = {5: 2, 7: 3}  # states that reduce to P, and the length of its right side
AFTER_P = {0: 3, 1: 4}
ACCEPTS = (0, 3, 4)
#: A stack for each state a top can be in between rows; what is below an equal top does not matter to what may follow.
STACKS = {0: (0, None), 1: (1, (0, None)), 2: (2, (0, None)), 3: (3, (0, None)), 4: (4, (1, (0, None))), 6: (6, (3, (0, None)))}

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, times)``: the damaged rows; ``times`` is 0 for a dropped row, 2 for a repeated one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def intact(rows: DataFrame) -> DataFrame:
    """Rows as ``damage`` gives them, undamaged."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("times", F.lit(1))


def initial(role: str) -> str:
    return role[:1] or " "


def _add(tops: dict, stack, cost: int, audit: str) -> bool:
    """Reduces, then merges the top with an equal one."""
    while stack[0] in POPS:
        for _ in range(POPS[stack[0]]):
            stack = stack[1]
        stack = (AFTER_P[stack[0]], stack)
    old = tops.get(stack[0])
    if old is None or (cost, audit) < old[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def _insert(tops: dict) -> None:
    """Turns may be inserted anywhere."""
    todo = list(tops)
    while todo:
        cost, audit, stack = tops[todo.pop()]
        for symbol in "ua":
            to = SHIFT.get((stack[0], symbol))
            if to is not None:
                reached: dict = {}
                _add(reached, (to, stack), cost + INSERT, audit + "I")
                ((state, top),) = reached.items()
                if _add(tops, top[2], top[0], top[1]):
                    todo.append(state)


def parse(tops: dict, symbols) -> dict:
    """Drives tops (state -> (cost, audit, stack)) over ``(initial, fault)`` of each row."""
    _insert(tops)
    for symbol, fault in symbols:
        new: dict = {}
        usable = fault not in ("blank", "duplicate")
        for cost, audit, stack in tops.values():
            _add(new, stack, cost + DELETE, audit + "D")
            if not usable:
                continue
            dear = cost + TRUNCATED if fault else cost
            to = SHIFT.get((stack[0], symbol))
            if to is not None:
                _add(new, (to, stack), dear, audit + "K")
            for other in "ua":
                to = SHIFT.get((stack[0], other))
                if to is not None:
                    _add(new, (to, stack), dear + REROLE, audit + "R")
        _insert(new)
        tops = new
    return tops


def start(state: int = 0) -> dict:
    return {state: (0, "", STACKS[state])}


def best(tops: dict) -> tuple[int, str]:
    return min(tops[s][:2] for s in ACCEPTS if s in tops)


def repaired(edits: str, rows, last: str = ""):
    """Applies edits to ``(role, text)`` rows, after a turn of initial ``last``; yields each ``role:text`` that stands."""
    rows = iter(rows)
    for e in edits:
        if e == "I":
            last = "a" if last == "u" else "u"
            yield f"{ROLES[last]}:"
            continue
        role, text = next(rows)
        if e == "K":
            last = initial(role)
            yield f"{role}:{text}"
        elif e == "R":
            last = "a" if last == "u" else "u"
            yield f"{ROLES[last]}:{text}"


def fault_of(text: str, seen: bool) -> str:
    end = text.rstrip(WHITE)
    return "blank" if not end else "duplicate" if seen else "" if end[-1] in ".!?" else "truncated"


class _Counts:
    """What is counted of rows in order; parts of a conversation can be added up."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = None

    def row(self, turn, symbol: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        self.illegal += bool(self.last) and self.last + symbol not in ("su", "ua", "au")
        self.first, self.last = self.first or symbol, symbol
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def add(self, other: "_Counts") -> None:
        for k, n in other.faults.items():
            self.faults[k] += n
        self.illegal += other.illegal + (bool(self.last) and bool(other.first) and self.last + other.first not in ("su", "ua", "au"))
        self.first, self.last = self.first or other.first, other.last or self.last
        if other.low is not None:
            self.turns += other.turns - (other.low == self.high)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def row_out(self, conv_id, cost: int, audit: str, digest: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv_id, gaps, *self.faults.values(), self.illegal, cost, audit, digest)


def repair(conv_id, rows: list[tuple]) -> tuple:
    """One conversation: its ``(turn, role, text)`` in order -> a row of OUT."""
    seen, counts, symbols = set(), _Counts(), []
    for turn, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        counts.row(turn, initial(role), fault)
        symbols.append((initial(role), fault))
    cost, audit = best(parse(start(), symbols))
    text = "\n".join(repaired(audit, ((r, t) for _, r, t in rows)))
    return counts.row_out(conv_id, cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _runs(batches, width: int):
    """Rows sorted by their first column -> (its value, iterator over the rows' other columns), one run after the other."""
    import itertools

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:width])))
    return itertools.groupby(rows, key=lambda r: r[0])


def _repair_all(batches):
    done = []
    for conv_id, rows in _runs(batches, 5):
        done.append(repair(conv_id, [(turn, role, text) for _, turn, role, text, times in rows for _ in range(times)]))
        if len(done) == 1000:
            yield _batch(done, OUT)
            done = []
    if done:
        yield _batch(done, OUT)


# ---- conversations that are cut into chunks

CHUNKED = "conv_id long, chunk long, place int, turn long, role string, text string"
MOVES = "conv_id long, chunk long, before int, after int, cost long, audit string, n int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
SLICES = "conv_id long, chunk long, edits string, last string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = "conv_id long, chunk long, text binary, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _cut(batches):
    """Sorted rows -> numbered chunks; numbers rise along the sort."""
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
    for conv_id, rows in _runs(batches, 5):
        place = 0
        for _, turn, role, text, times in rows:
            # a chunk keeps a row for a conversation whose rows are all dropped
            for row in [(turn, role, text)] * times or [(None, None, None)]:
                held.append((conv_id, chunk, place, *row))
                place, size = place + 1, size + len(row[2] or "") + 16
            if place >= LONG_ROWS or size >= LONG_BYTES:
                yield _batch(held, CHUNKED)
                chunk, place, held, size = chunk + 1, 0, [], 0
        if held:
            yield _batch(held, CHUNKED)
        chunk, held, size = chunk + 1, [], 0


def _moves(key, table):
    """A chunk's (initial, fault, turn) in order -> least (cost, audit) from each state to each."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "turn", "symbol", "fault"))), key=lambda r: r[0])
    rows = [r for r in rows if r[2] is not None]
    counts = _Counts()
    for _, turn, symbol, fault in rows:
        counts.row(turn, symbol, fault)
    stats = (*counts.faults.values(), counts.illegal, counts.turns, counts.low, counts.high, counts.first, counts.last)
    symbols, head = [r[2:] for r in rows], tuple(k.as_py() for k in key)
    out = []
    for before in STACKS:
        for after, (cost, audit, _) in parse(start(before), symbols).items():
            out.append((*head, before, after, cost, audit, len(rows), *stats))
    return pa.Table.from_batches([_batch(out, MOVES)])


def _initial_before(audit: str, place: int) -> str:
    """The last initial that stands before a place of the edits; of an odd number that stand, the first is a system turn."""
    n = place - audit.count("D", 0, place)
    odd = (len(audit) - audit.count("D")) % 2
    return "" if not n else "s" if odd and n == 1 else "u" if (n + odd) % 2 else "a"


def _join_moves(batches):
    """Moves sorted by (conversation, chunk) -> each chunk's edits, and the conversation's values with its first chunk."""
    for conv_id, rows in _runs(batches, 16):
        tops, counts, sizes, at = {0: (0, "")}, _Counts(), [], None
        new: dict = {}
        for r in rows:
            if r[1] != at:
                tops, new, at = new or tops, {}, r[1]
                part = _Counts()
                part.faults = dict(zip(part.faults, r[7:10]))
                part.illegal, part.turns, part.low, part.high, part.first, part.last = r[10:16]
                counts.add(part)
                sizes.append((r[1], r[6]))
            if r[2] in tops:
                cost, audit = tops[r[2]]
                found = (cost + r[4], audit + r[5])
                if r[3] not in new or found < new[r[3]]:
                    new[r[3]] = found
        tops = new or tops
        cost, audit = min(tops[s] for s in ACCEPTS if s in tops)
        values = counts.row_out(conv_id, cost, audit, "")[1:-1]
        place = 0
        for k, (chunk, n) in enumerate(sizes):
            end = place
            while n and end < len(audit):  # the chunk's rows, and what is inserted before them
                n -= audit[end] != "I"
                end += 1
            if k == len(sizes) - 1:
                end = len(audit)
            yield _batch([(conv_id, chunk, audit[place:end], _initial_before(audit, place), *(values if not k else [None] * len(values)))], SLICES)
            place = end


def _apply_edits(key, rows, slices):
    texts = sorted(zip(*(rows.column(c).to_pylist() for c in ("place", "role", "text"))), key=lambda r: r[0])
    edits = slices.column("edits")[0].as_py()
    standing = list(repaired(edits, ((r, t) for _, r, t in texts if r is not None), slices.column("last")[0].as_py()))
    data = "\n".join(standing).encode("utf-8", "surrogatepass") if standing else None
    values = [slices.column(c)[0].as_py() for c in _schema(SLICES).names[4:]]
    return pa.Table.from_batches([_batch([(*(k.as_py() for k in key), data, *values)], PIECES)])


def _digest(batches):
    for conv_id, pieces in _runs(batches, 10):
        digest, any_text, values = hashlib.sha256(), False, None
        for _, _, data, *mine in pieces:
            if data is not None:
                digest.update(b"\n" + data if any_text else data)
                any_text = True
            values = mine if values is None else values
        yield _batch([(conv_id, *values, digest.hexdigest())], OUT)


def _ordered() -> list:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _repair_long(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows may be dealt to several tasks
    order = [*_ordered(), F.col("salt")]
    rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    chunks = store(rows.select("conv_id", "turn", "role", "text", "times").mapInArrow(_cut, CHUNKED))
    there = chunks.filter("text is not null")
    same = [F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("id"), F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("said")]
    first = there.select(*same, F.struct("chunk", "place").alias("at")).groupBy("id", "said").agg(F.min("at").alias("first"))
    plain = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = chunks.select("conv_id", "chunk", "place", "turn", "role", "text", *same).join(first, ["id", "said"], "left")
    fault = (
        F.when(plain == "", "blank").when(F.struct("chunk", "place") > F.col("first"), "duplicate")
        .when(~F.substring(plain, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    )
    symbol = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    facts = facts.select("conv_id", "chunk", "place", "turn", symbol.alias("symbol"), fault.alias("fault"))
    moves = store(facts.groupBy("conv_id", "chunk").applyInArrow(_moves, MOVES))
    by_chunk = [F.col("conv_id").asc_nulls_first(), F.col("chunk")]
    slices = store(moves.repartition(parts(spark), "conv_id").sortWithinPartitions(*by_chunk).mapInArrow(_join_moves, SLICES))
    pieces = chunks.groupBy("conv_id", "chunk").cogroup(slices.groupBy("conv_id", "chunk")).applyInArrow(_apply_edits, PIECES)
    return pieces.repartition(parts(spark), "conv_id").sortWithinPartitions(*by_chunk).mapInArrow(_digest, OUT)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, times)`` of ``damage`` or ``intact`` -> one row per ``conv_id``: faults, edits, digest."""
    spark = rows.sparkSession
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = store(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long")))
    short, out = rows, None
    if long.limit(1).count():
        marked = rows.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
        out = _repair_long(marked.filter("long").select(*rows.columns))
        short = marked.filter("long is null").select(*rows.columns)
    short = short.repartition(parts(spark), "conv_id").sortWithinPartitions(*_ordered()).mapInArrow(_repair_all, OUT)
    return short if out is None else short.unionByName(out)
