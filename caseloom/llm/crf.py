"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What the field sees of a line are shares of character kinds, word lengths, repeated words and
lines, together with those of the line before and after; neighbouring labels are tied by transition weights. Labels are
known per document only: lines of good documents are good; in bad documents the lines that look bad under the
current model are bad (at least the worst one), and the field is fitted again.

The chance of a line to be bad comes from the forward-backward algorithm. A document's bad share is the mean over its
lines, weighted by their lengths, and a logistic curve fitted to the labels turns the share into a score.

The field is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their id, and on at most
``SAMPLE_LINES`` consecutive lines of each. Scores use whole texts and nothing but the text.

Defined results: null and empty texts have no line and a bad share of 0. A document with several labels counts with
the lowest. Repeated rows give repeated rows. Without labels, or with labels of one kind only, every score is the
share of label 1 (0.5 without labels). An empty table gives no rows. Further columns do not matter.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the field is fitted on, at most.
SAMPLE = 8000
#: Consecutive lines of each that are used, at most.
SAMPLE_LINES = 120
#: Rounds of labelling the lines of bad documents anew.
ROUNDS = 3
STEPS = 150
KINDS = 7
FEATURES = 20


def _kinds() -> np.ndarray:
    """The kind of each byte: 0 letter, 1 capital, 2 digit, 3 space, 4 punctuation, 5 other sign, 6 bar."""
    out = np.full(256, 5, np.uint8)
    out[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
    out[128:] = 0
    out[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
    out[[ord(c) for c in "0123456789"]] = 2
    out[[ord(c) for c in " \t\r\v\f"]] = 3
    out[[ord(c) for c in ".,;:'\"()-?"]] = 4
    out[ord("|")] = 6
    return out


_KIND = _kinds()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, length of each line in bytes)."""
    data = (text or "").encode()
    if not data:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0)
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    # the line break itself belongs to the line it ends, and is counted as nothing
    owner = np.repeat(np.arange(len(lines)), sizes + 1)[: len(data)]
    cell = owner * (KINDS + 1) + kinds
    cell[np.cumsum(sizes + 1)[:-1] - 1] = owner[np.cumsum(sizes + 1)[:-1] - 1] * (KINDS + 1) + KINDS
    share = np.bincount(cell, minlength=len(lines) * (KINDS + 1)).reshape(-1, KINDS + 1)[:, :KINDS] / np.maximum(sizes, 1)[:, None]
    words = np.zeros((len(lines), 4))
    before: set[bytes] = set()
    for k, line in enumerate(lines):
        w = line.split()
        n = len(w)
        if n:
            words[k] = n, 1 - len(set(w)) / n, sum(map(eq, w, w[1:])) / n, line in before
            before.add(line)
    n = np.maximum(words[:, 0], 1)
    x = np.zeros((len(lines), FEATURES), np.float32)
    x[:, :KINDS] = share
    x[:, 7] = np.log1p(sizes) / 6
    x[:, 8] = np.minimum(sizes / n / 10, 5)
    x[:, 9:12] = words[:, 1:]
    x[:, 12] = share[:, 5] > 0.03
    x[:, 13] = share[:, 5] > 0.1
    x[:, 14] = share[:, 1] > 0.3
    x[:, 15] = share[:, 1] > 0.6
    x[:, 16] = share[:, 6] > 0.02
    x[:, 17] = words[:, 2] > 0.2
    x[:, 18] = words[:, 1] > 0.5
    x[:, 19] = words[:, 0] <= 2
    return x, sizes.astype(float)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, and a constant."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), np.ones((len(x), 1), x.dtype)])


def _log_add(a, b):
    return np.logaddexp(a, b)


def marginals(node: np.ndarray, there: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded chains.

    ``node``: (chains, lines) score of bad against good; ``there``: which lines exist (a prefix of each row);
    ``pair``: 2 x 2 transition scores. Returns the chance to be bad, and the expected transitions (2 x 2).
    """
    chains, most = node.shape
    emit = np.stack([np.zeros_like(node), node], axis=2)
    fore = np.zeros((chains, most, 2))
    back = np.zeros((chains, most, 2))
    fore[:, 0] = emit[:, 0]
    for t in range(1, most):
        step = emit[:, t] + _log_add(fore[:, t - 1, 0, None] + pair[0], fore[:, t - 1, 1, None] + pair[1])
        fore[:, t] = np.where(there[:, t, None], step, fore[:, t - 1])
    for t in range(most - 2, -1, -1):
        ahead = emit[:, t + 1] + back[:, t + 1]
        step = _log_add(ahead[:, 0, None] + pair[:, 0], ahead[:, 1, None] + pair[:, 1])
        back[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    both = fore + back
    total = _log_add(both[..., 0], both[..., 1])
    bad = np.exp(both[..., 1] - total) * there
    moves = np.zeros((2, 2))
    if most > 1:
        on = there[:, 1:]
        for a in range(2):
            for b in range(2):
                s = fore[:, :-1, a] + pair[a, b] + emit[:, 1:, b] + back[:, 1:, b] - total[:, 1:]
                moves[a, b] = np.exp(np.where(on, s, -np.inf)).sum()
    return bad, moves


def _padded(chains: list[np.ndarray], width: int):
    most = max(len(c) for c in chains)
    out = np.zeros((len(chains), most, width))
    there = np.zeros((len(chains), most), bool)
    for k, c in enumerate(chains):
        out[k, : len(c)] = c
        there[k, : len(c)] = True
    return out, there


def _groups(sizes: np.ndarray, most: int = 60_000):
    """Positions of chains of similar length, so that padding stays small."""
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * sizes[order[b]] <= most and sizes[order[b]] <= 2 * sizes[order[a]] + 4:
            b += 1
        yield order[a:b]
        a = b


class Field:
    """Weights of the field and of the curve on top of it."""

    def __init__(self, width: int = 3 * FEATURES + 1):
        self.weights, self.pair = np.zeros(width), np.zeros((2, 2))
        self.curve = None  # (constant, share, log share), or None: the prior
        self.prior = 0.5

    def shares(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted bad share of each document."""
        out = np.zeros(len(docs))
        sizes = np.array([len(x) for x, _ in docs])
        for group in _groups(sizes):
            group = group[sizes[group] > 0]
            if not len(group):
                continue
            node, there = _padded([(with_neighbours(docs[k][0]) @ self.weights)[:, None] for k in group], 1)
            bad, _ = marginals(node[..., 0], there, self.pair)
            for row, k in enumerate(group):
                weight = docs[k][1] + 1
                out[k] = (bad[row, : len(weight)] * weight).sum() / weight.sum()
        return out

    def _inputs(self, share: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(share)), share, np.log(share + 1e-3)])

    def scores(self, docs) -> np.ndarray:
        if self.curve is None:
            return np.full(len(docs), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._inputs(self.shares(docs)) @ self.curve, -500, 500)))

    def _fit_lines(self, groups, targets, total: int) -> None:
        """Gradient ascent (Adam) on the log likelihood of the targets."""
        flat = np.concatenate([self.weights, self.pair.ravel()])
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for step in range(1, STEPS + 1):
            w, pair = flat[:-4], flat[-4:].reshape(2, 2)
            slope = -1e-3 * flat * total / 100
            for (x, there), y in zip(groups, targets):
                bad, moves = marginals(x @ w, there, pair)
                slope[:-4] += np.einsum("ct,ctf->f", (y - bad) * there, x)
                on = there[:, 1:]
                seen = [((1 - y[:, :-1]), y[:, :-1]), ((1 - y[:, 1:]), y[:, 1:])]
                want = np.array([[(seen[0][a] * seen[1][b] * on).sum() for b in range(2)] for a in range(2)])
                slope[-4:] += (want - moves).ravel()
            slope /= total
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            flat = flat + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.weights, self.pair = flat[:-4], flat[-4:].reshape(2, 2)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> "Field":
        if len(good):
            self.prior = float(good.mean())
        full = np.array([k for k in range(len(docs)) if len(docs[k][0])], int)
        if not len(full) or len(set(good[full].tolist())) < 2:
            return self
        sizes = np.array([len(docs[k][0]) for k in full])
        members = [full[g] for g in _groups(sizes)]
        groups = [_padded([with_neighbours(docs[k][0]) for k in g], len(self.weights)) for g in members]
        targets = [np.where(good[g][:, None] == 1, 0.0, 1.0) * there for g, (_, there) in zip(members, groups)]
        total = int(sizes.sum())
        self._fit_lines(groups, targets, total)
        for _ in range(ROUNDS):
            for k, (g, (x, there)) in enumerate(zip(members, groups)):
                bad, _ = marginals(x @ self.weights, there, self.pair)
                worst = bad == bad.max(axis=1, keepdims=True)
                targets[k] = np.where(good[g][:, None] == 1, 0.0, ((bad > 0.5) | worst) * 1.0) * there
            self._fit_lines(groups, targets, total)
        self._fit_curve(self.shares(docs), good)
        return self

    def _fit_curve(self, share: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        x, w = self._inputs(share), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (good - p) - 1e-2 * w
            bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            step = np.linalg.solve(bend, slope)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w


def _sampled(batches):
    for batch in batches:
        rows = []
        for doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
            x, sizes = line_features(text)
            at = 0 if len(x) <= SAMPLE_LINES else hash(doc) % (len(x) - SAMPLE_LINES)
            x, sizes = x[at : at + SAMPLE_LINES], sizes[at : at + SAMPLE_LINES]
            rows.append((label, x.astype("<f4").tobytes(), sizes.astype("<f4").tobytes()))
        if rows:
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["label", "x", "sizes"])


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Field:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)`` -> a fitted field; labels only where ``usable`` holds."""
    spark = docs.sparkSession
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # bounded by ``sample``
    names = spark.createDataFrame([tuple(r) for r in chosen], known.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(names), "doc_id")
    rows = rows.select("doc_id", "label", "text").mapInArrow(_sampled, "label int, x binary, sizes binary").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["sizes"]), bytes(r["x"])))
    chains = [(np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES), np.frombuffer(r["sizes"], "<f4").astype(float)) for r in rows]
    return Field().fit(chains, np.array([r["label"] for r in rows], float))


def _scorer(field: Field, text: int, keep: int, out_name: str):
    def run(batches):
        for batch in batches:
            texts, out = batch.column(text), []
            for a in range(0, len(batch), 500):
                out.append(field.scores([line_features(t) for t in texts.slice(a, 500).to_pylist()]))
            score = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], score], names=[*batch.schema.names[:keep], out_name])

    return run


def score_quality(docs: DataFrame, field: Field, keep: list[str], out: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, named ``out``."""
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = docs.select(*keep, F.lit(0.0).alias(out)).schema
    return rows.mapInArrow(_scorer(field, rows.columns.index("text"), len(keep), out), schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
