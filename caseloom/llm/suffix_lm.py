"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased (A-Z) words and one end per document; the end also stands before the first word. The root
is the add-one unigram distribution. A context of one to ``depth`` tokens is a candidate if it occurs ``LEAST`` times in the
training part, whatever the size of the corpus (an optional ``share`` of the training tokens raises that). A candidate becomes a state if its next-token distribution diverges from its parent's: the mean log ratio of its
smoothed, leave-one-out predictions to the parent's must be ``GAIN`` nats or more. Smoothing adds
``strength`` pseudo-counts of the parent's distribution; each state takes the strength that predicts best. A token is
scored by the longest suffix of what stands before it that is a state.

Every level counts all (context, next token) pairs of the corpus. Counting goes by blocks (see ``blocks``): documents become word
codes in one pass, and each level sends one packed list of distinct pairs per block and key range. Words, contexts and pairs are
known by 64-bit hashes; a pair's first 16 bits are its context's, so a range holds all pairs of its contexts and decides alone
which of them are states. It answers each pair with its count and each context with its strength. A pair is the next level's
context, so a block reads the counts of its contexts from the last level's answers, and no list of contexts is gathered anywhere.

What moves is small numbers. Once words are counted, they are numbered by falling count, so a word's number tells its count (``Numbers``
holds where each count begins), frequent words have short numbers, and the blocks are stored again with these instead of hashes. A list names each
context once by its words' numbers, and a pair by its next token; ranges make the hashes of these and the parent's chances, from the counts of the shorter pairs.
The shuffles of a level are removed when its answers are stored.

Defined results: a null or empty text is one end token. A null ``doc_id`` belongs to the training part. Repeated rows count and are
scored once each. Without training rows all counts are 0. An empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import blocks as B
from caseloom.llm.common import alone, discard, store_alone

DEPTH = 3
#: Least number of a context.
LEAST = 8
#: Least mean gain over the parent, in nats.
GAIN = 0.02
STRENGTHS = np.array([4.0, 32.0, 256.0])
BLOCK_BYTES = 8 << 20

CODED = "block long, ids array<long>, sizes binary, held binary, codes binary, words binary, n_keys long, train_tokens long, counts binary, kind int"
SENT = "block long, part int, level int, keys binary, counts binary, more binary"
_SENT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())])
_CODED = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("held", pa.binary()), ("codes", pa.binary()),
    ("words", pa.binary()), ("n_keys", pa.int64()), ("train_tokens", pa.int64()), ("counts", pa.binary()), ("kind", pa.int32()),
])
#: Kinds of rows of a coded block: its words and their counts are in a row of their own, which goes when words have numbers.
_TOKENS, _WORDS = 0, 1
_STATS = -1
#: Bits of a pair's key that are its context's; ranges are cut by these only.
_OF_CONTEXT = np.uint64(0xFFFF << 48)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def is_held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _coded_row(number: int, ids: list, texts: list) -> pa.RecordBatch:
    import xxhash

    codes = _Codes()
    get = codes.__getitem__
    end = get(b"")
    flat, sizes = [], []
    for t in texts:
        w = (t or "").encode().lower().split()
        flat.append(np.fromiter(map(get, w), np.int32, len(w)))
        flat.append(np.array([end], np.int32))
        sizes.append(len(w) + 1)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes))
    order = np.argsort(words)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    held = np.array([is_held_out(i) for i in ids])
    train = np.repeat(~held, sizes)
    flat = rank[np.concatenate(flat)]
    counts = np.bincount(flat[train], minlength=len(words)).astype(np.int64)
    rows = [
        (number, ids, B.pack(np.array(sizes, np.int64)), B.pack_bits(held), B.pack(flat), None, len(words), int(train.sum()), None, _TOKENS),
        (number, None, None, None, None, B.pack_sorted(words[order]), 0, 0, B.pack(counts), _WORDS),
    ]
    return B.batch_of(_CODED, rows).to_batches()[0]


def _code(batches):
    sequence, size, ids, texts = 0, 0, [], []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text or "") + 16
            if size >= BLOCK_BYTES:
                yield _coded_row(B.block_number(sequence), ids, texts)
                sequence, size, ids, texts = sequence + 1, 0, [], []
    if ids:
        yield _coded_row(B.block_number(sequence), ids, texts)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _extend(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a context and the token after it."""
    return _mix(context * np.uint64(0xD6E8FEB86659FD93) + token + np.uint64(0x632BE59BD9B4E019))


def _hash(tokens: list[np.ndarray]) -> np.ndarray:
    """Hash of a context from its tokens' hashes, the oldest first."""
    h = tokens[0]
    for t in tokens[1:]:
        h = _extend(h, t)
    return h


def _ranges_of(context: np.ndarray, n: int) -> np.ndarray:
    return (context >> np.uint64(48)).astype(np.int64) * n >> 16


def _pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return (context & _OF_CONTEXT) | (_extend(context, token) & ~_OF_CONTEXT)


class Level:
    """What a key range knows of one depth: its contexts (sorted hashes), their counts, and which are states."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray):
        order = np.argsort(contexts)
        self.contexts, self.counts = contexts[order], counts[order].astype(float)
        self.strength = np.zeros(len(contexts), np.uint8)

    def decide(self, which: np.ndarray, total: np.ndarray, parent: np.ndarray) -> None:
        """``strength`` from all seen pairs: one more than the place in STRENGTHS of a state's, 0 for the others."""
        own = self.counts[which]
        gains = np.array([
            np.bincount(which, weights=total * np.log((total - 1 + s * parent) / (own - 1 + s) / parent), minlength=len(self.contexts))
            for s in STRENGTHS
        ])
        state = gains.max(axis=0) / np.maximum(self.counts, 1) >= GAIN
        self.strength = np.where(state, gains.argmax(axis=0) + 1, 0).astype(np.uint8)


class Block:
    """A block's tokens, as places in its sorted ``words`` (their numbers)."""

    def __init__(self, table: pa.Table):
        get = {c: table.column(c)[0].as_py() for c in ("block", "ids", "sizes", "held", "codes", "words")}
        self.number, self.ids = get["block"], get["ids"]
        self.sizes = B.unpack(get["sizes"], "i8")
        self.held = B.unpack_bits(get["held"], len(self.ids))
        self.codes = B.unpack(get["codes"], "i4")
        self.words = B.unpack_sorted(get["words"], "u8")
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the ``depth`` tokens before each token, whether there are as many)."""
        n = len(self.codes)
        tokens = _mix(self.words)[self.codes]
        before = np.concatenate([np.repeat(tokens[-1], depth), tokens])  # a document's last token stands for the next one's beginning
        place = np.arange(n) - np.repeat(self.first, self.sizes)
        return _hash([before[j : j + n] for j in range(depth)]), place >= depth - 1

    def next_contexts(self, total: np.ndarray, at_first: int = 0) -> np.ndarray:
        """Of each place, the count of the context that the place before makes with its own."""
        own = np.concatenate([[0], total[:-1]])
        own[self.first] = at_first
        return own


class Pairs:
    """A block's distinct pairs of one depth, of contexts that are candidates, in the order of their words' numbers.

    ``of`` numbers each place's context within the block. Contexts and pairs go to ranges by the context's hash;
    ``by_range`` and ``contexts_by_range`` are their places in the order sent, and the cuts say where each range begins.
    """

    def __init__(self, b: Block, depth: int, of: np.ndarray, own: np.ndarray, least: float, n: int):
        h, ok = b.contexts(depth)
        self.at = np.flatnonzero(ok & (own >= least))
        bits = np.uint64(len(b.words).bit_length())
        keys, self.place = np.unique(of[self.at].astype(np.uint64) << bits | b.codes[self.at].astype(np.uint64), return_inverse=True)
        some = np.zeros(len(keys), np.int64)
        some[self.place] = self.at
        self.some = some  # any occurrence of a pair: what is known of its context and its shorter pairs is the same in all
        new = np.diff(keys >> bits, prepend=np.uint64(1 << 63)) != 0
        self.which, self.some_context = np.cumsum(new) - 1, some[new]
        part = _ranges_of(h[self.some_context], n)
        self.contexts_by_range = np.argsort(part, kind="stable")
        self.by_range = np.argsort(part[self.which], kind="stable")
        self.context_cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n))])
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(part[self.which], minlength=n))])

    def answers(self, answers: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the pairs, and the strengths of their contexts."""
        out, strength = np.zeros(len(self.some), np.int64), np.zeros(len(self.some_context), np.uint8)
        mine = answers.filter(pa.compute.equal(answers.column("level"), level))
        for p, data, more in zip(*(mine.column(c).to_pylist() for c in ("part", "counts", "more"))):
            out[self.by_range[self.cuts[p] : self.cuts[p + 1]]] = B.unpack(data, "i8")
            strength[self.contexts_by_range[self.context_cuts[p] : self.context_cuts[p + 1]]] = B.unpack(more, "u1")
        return out, strength[self.which]


def _frame(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, of numbers from 0, as byte planes of the least width, compressed together: lists can be short."""
    widths = bytes(next(w for w in (1, 2, 4, 8) if int(x.max()) < 1 << 8 * w) for x in columns)
    planes = [x.astype(f"u{w}").view(np.uint8).reshape(len(x), w).T.tobytes() for x, w in zip(columns, widths)]
    return bytes([len(columns)]) + widths + len(columns[0]).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unframe(data: bytes) -> list[np.ndarray]:
    widths, n = list(data[1 : 1 + data[0]]), int.from_bytes(data[1 + data[0] : 9 + data[0]], "little")
    raw = pa.decompress(data[9 + data[0] :], decompressed_size=n * sum(widths), codec="zstd", asbytes=True)
    planes = np.split(np.frombuffer(raw, np.uint8), np.cumsum(widths)[:-1] * n)
    return [np.ascontiguousarray(x.reshape(w, n).T).view(f"u{w}").ravel().astype(np.int64) for x, w in zip(planes, widths)]


def _send_words(n: int):
    def run(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, counts = B.unpack_sorted(words, "u8"), B.unpack(counts, "i8")
                cuts = B.range_cuts(words, n)
                rows = [(block, p, 0, B.pack_sorted(words[x:y]), B.pack(counts[x:y]), None) for p, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                yield from B.batch_of(_SENT, rows).to_batches()

    return run


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]):
    """(distinct keys, totals, place of each sent key)."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    return distinct, totals, place


def _split(x: np.ndarray, lists: list) -> list[bytes]:
    """Packed parts of ``x``, as long as each of ``lists``."""
    return [B.pack(t) for t in np.split(x, np.cumsum([len(y) for y in lists])[:-1])]


def _sum_words(key, table):
    """A word's answer is its place in its range by falling count; the range's counts and how many words have each go to the driver."""
    part = key[0].as_py()
    sent = [B.unpack_sorted(x, "u8") for x in table.column("keys").to_pylist()]
    _, totals, place = _sum(sent, [B.unpack(x, "i8") for x in table.column("counts").to_pylist()])
    at = np.empty(len(totals), np.int64)
    at[np.argsort(-totals, kind="stable")] = np.arange(len(totals))
    values, number = np.unique(totals, return_counts=True)
    rows = [(b, part, 0, None, t, None) for b, t in zip(table.column("block").to_pylist(), _split(at[place], sent))]
    return B.batch_of(_SENT, [*rows, (_STATS, part, 0, None, B.pack(values[::-1]), B.pack(number[::-1].astype(np.int64)))])


class Numbers:
    """Numbers of words by falling count; words of one count go by range, then by their place there."""

    def __init__(self, parts: list[int], values: list[np.ndarray], numbers: list[np.ndarray]):
        sizes = np.array([len(v) for v in values], np.int64)
        part = np.repeat(np.array(parts, np.int64), sizes)
        value, number = (np.concatenate([np.empty(0, np.int64), *x]) for x in (values, numbers))
        order = np.lexsort((part, -value))
        start = np.empty(len(order), np.int64)
        start[order] = np.cumsum(number[order]) - number[order]
        #: range -> (places there at which a count begins, numbers at which it does)
        self.starts = {p: (np.cumsum(n) - n, s) for p, n, s in zip(parts, numbers, np.split(start, np.cumsum(sizes)[:-1]))}
        self.values, first = np.unique(-value[order], return_index=True)
        self.values, self.first = -self.values, start[order][first]
        self.distinct = int(number[value > 0].sum())

    def of(self, part: int, at: np.ndarray) -> np.ndarray:
        places, numbers = self.starts[part]
        group = np.searchsorted(places, at, "right") - 1
        return numbers[group] + at - places[group]


def _number_words(numbers: Numbers):
    """The blocks again, with numbers for hashes. What the ranges answer, one after the other, is in the order of the hashes."""

    def run(key, table, answers):
        if not table.num_rows:
            return B.batch_of(_CODED, [])
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "counts"))))
        known = np.concatenate([numbers.of(p, B.unpack(data, "i8")) for p, data in told])
        order = np.argsort(known)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        codes = rank[B.unpack(table.column("codes")[0].as_py(), "i4")]
        new = {"codes": B.pack(codes), "words": B.pack_sorted(known[order].astype(np.uint64))}
        return B.batch_of(_CODED, [tuple(new.get(c, table.column(c)[0].as_py()) for c in _CODED.names)])

    return run


class Model:
    def __init__(self, tokens: int, numbers: Numbers, n: int, least: float):
        self.tokens, self.distinct, self.n, self.least = tokens, numbers.distinct, n, least
        self.values, self.first = numbers.values, numbers.first

    def count(self, words: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.first, words.astype(np.int64), "right") - 1]

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.distinct + 1)


class Told:
    """What the answers up to a depth say of each place of a block."""

    def __init__(self, model: Model, b: Block, answers: pa.Table, depth: int):
        counts = model.count(b.words)
        self.count = counts[b.codes]
        #: after the longest state of at most ``depth`` tokens
        self.chance = model.root(self.count)
        #: by depth: counts of contexts, of pairs in states, and one more than the state's place in STRENGTHS
        self.own, self.total, self.state = [b.next_contexts(self.count, counts[b.codes[-1]])], [], []
        self.of = np.concatenate([b.codes[-1:], b.codes[:-1]])
        for d in range(1, depth + 1):
            own, pairs = self.own[-1], self.pairs(model, b, d)
            told, strengths = pairs.answers(answers, d)
            total, state, self.of = np.zeros(len(b.codes), np.int64), np.zeros(len(b.codes), np.uint8), np.zeros(len(b.codes), np.int64)
            total[pairs.at], state[pairs.at] = told[pairs.place], strengths[pairs.place]
            self.of[pairs.at[pairs.at < len(b.codes) - 1] + 1] = pairs.place[pairs.at < len(b.codes) - 1]
            self.chance = _blend(self.chance, total, own, state)
            self.own.append(b.next_contexts(total))
            self.total.append(np.where(state > 0, total, 0))
            self.state.append(state)

    def pairs(self, model: Model, b: Block, depth: int) -> Pairs:
        """Tokens whose context of ``depth`` tokens is a candidate, all answers up to which are known."""
        return Pairs(b, depth, self.of, self.own[-1], model.least, model.n)


def _blend(chance: np.ndarray, total: np.ndarray, own: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Chances after contexts one token longer; as they are where these are no states."""
    at = np.flatnonzero(state)
    strength = STRENGTHS[state[at] - 1]
    chance = chance.copy()
    chance[at] = (total[at] + strength * chance[at]) / (own[at] + strength)
    return chance


def _send_pairs(model: Model, depth: int):
    def run(key, table, answers):
        if not table.num_rows:
            return B.batch_of(_SENT, [])
        b = Block(table)
        told = Told(model, b, answers, depth - 1)
        pairs = told.pairs(model, b, depth)
        counts = np.bincount(pairs.place, weights=b.train[pairs.at], minlength=len(pairs.some)).astype(np.int64)[pairs.by_range]
        some, context = pairs.some[pairs.by_range], pairs.some_context[pairs.contexts_by_range]
        follow = np.bincount(pairs.which, minlength=len(context))[pairs.contexts_by_range]
        words = b.words.astype(np.int64)
        oldest, *newer = (words[b.codes[context - j]] for j in range(depth, 0, -1))
        of_context = [*newer, follow, *(x[context] for x in told.own[1:]), *(x[context] for x in told.state)]
        token, start = words[b.codes[some]], np.cumsum(follow) - follow
        step = np.diff(token, prepend=0)
        step[start] = token[start]  # a context's tokens ascend
        of_pair = [counts, step, *(x[some] for x in told.total)]
        rows = []
        for p in np.flatnonzero(np.diff(pairs.cuts)):
            x, y = slice(*pairs.context_cuts[p : p + 2]), slice(*pairs.cuts[p : p + 2])
            columns = [np.diff(oldest[x], prepend=0), *(c[x] for c in of_context)]
            rows.append((b.number, int(p), depth, _frame(columns), None, _frame([c[y] for c in of_pair])))
        return B.batch_of(_SENT, rows)

    return run


def _sum_pairs(model: Model, depth: int):
    def run(key, table):
        contexts, keys, counts, own, chance, which, at = [], [], [], [], [], [], 0
        for c, p in zip(*(table.column(c).to_pylist() for c in ("keys", "more"))):
            columns = _unframe(c)
            before, follow, known = [np.cumsum(columns[0]), *columns[1:depth]], columns[depth], columns[depth + 1 :]
            owns, states = [model.count(before[-1]), *known[: depth - 1]], known[depth - 1 :]
            count, step, *totals = _unframe(p)
            token, start = np.cumsum(step), np.cumsum(follow) - follow
            token -= np.repeat(token[start] - step[start], follow)
            mine = np.repeat(np.arange(len(follow)), follow)
            parent = model.root(model.count(token))
            for total, o, state in zip(totals, owns, states):
                parent = _blend(parent, total, o[mine], state[mine])
            contexts.append(_hash([_mix(x.astype(np.uint64)) for x in before]))
            keys.append(_pair_keys(contexts[-1][mine], _mix(token.astype(np.uint64))))
            counts.append(count)
            own.append(owns[-1])
            chance.append(parent)
            which.append(mine + at)
            at += len(follow)
        distinct, totals, place = _sum(keys, counts)
        used, context = np.unique(np.concatenate(contexts), return_inverse=True)
        counted, parent, of = np.empty(len(used), np.int64), np.empty(len(distinct)), np.empty(len(distinct), np.int64)
        counted[context], parent[place], of[place] = np.concatenate(own), np.concatenate(chance), context[np.concatenate(which)]
        level = Level(used, counted)
        seen = totals > 0
        level.decide(of[seen], totals[seen].astype(float), parent[seen])
        told = zip(table.column("block").to_pylist(), _split(totals[place], keys), _split(level.strength[context], contexts))
        return B.batch_of(_SENT, [(b, key[0].as_py(), depth, None, t, m) for b, t, m in told])

    return run


def _score(model: Model, depth: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def run(key, table, answers):
        if not table.num_rows:
            return B.batch_of(schema, [])
        b = Block(table)
        told = Told(model, b, answers, depth)
        count, chance = told.count, told.chance
        sums = [
            np.add.reduceat(x, b.first)
            for x in ((count > 0).astype(np.int64), np.log10(model.root(count)), np.log10(chance))
        ]
        cols = [b.ids, b.held, b.sizes, sums[0], np.full(len(b.ids), model.tokens), sums[1], sums[2]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def score_texts(docs: DataFrame, depth: int = DEPTH, share: float = 0.0, range_keys: int = B.RANGE_KEYS) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row: token counts, unigram score and suffix-tree score (log10)."""
    spark = docs.sparkSession
    coded = B.bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_code, CODED), "kind")
    tokens_of, words_of = coded.filter(F.col("kind") == _TOKENS), coded.filter(F.col("kind") == _WORDS)
    size = tokens_of.agg(F.sum("n_keys"), F.sum("train_tokens"), F.sum(F.octet_length("codes"))).first()
    tokens = size[1] or 0
    least = max(LEAST, share * tokens)
    # pairs per block are at most its tokens; packed codes take about two bytes each
    n, n_pairs = B.ranges(size[0] or 0, range_keys), min(B.ranges((size[2] or 0) // 4, range_keys), 1 << 16)  # a context's pairs stay together
    sent = words_of.select("block", "words", "counts").mapInArrow(_send_words(n), SENT)
    done = store_alone(sent.groupBy("part").applyInArrow(_sum_words, SENT))
    discard(words_of)
    stats = done.filter(F.col("block") == _STATS).select("part", "counts", "more").collect()  # one row per range
    numbers = Numbers([r[0] for r in stats], *([B.unpack(r[k], "i8") for r in stats] for k in (1, 2)))
    model = Model(tokens, numbers, n_pairs, least)
    told = done.filter(F.col("block") != _STATS)
    with alone(spark):
        numbered = B.bucketed(tokens_of.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_number_words(numbers), CODED))
    discard(tokens_of, done)
    by_block = numbered.groupBy("block")
    told = spark.createDataFrame(_SENT.empty_table(), SENT)
    for d in range(1, depth + 1):
        sent = by_block.cogroup(told.groupBy("block")).applyInArrow(_send_pairs(model, d), SENT)
        told = told.unionByName(store_alone(sent.groupBy("part").applyInArrow(_sum_pairs(model, d), SENT)))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(told.groupBy("block")).applyInArrow(_score(model, depth), out)
