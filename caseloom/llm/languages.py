"""Language of a text by rank-order profiles of its n-grams.

A text is lower-cased; every run of characters that are not letters becomes one space, and one space stands before and behind
it. Its n-grams are all sequences of one to three characters of that, other than a space alone. A profile lists the ``TOP`` most
frequent n-grams, ties by the characters' code points. A language's profile is counted over all its texts of the training part. The
out-of-place distance between a text and a language adds, over the text's profile, how far apart an n-gram's two ranks
are, or ``TOP`` if the language's profile lacks it. The nearest language is the answer, ties by name; the score is 1 minus the
distance as a share of the largest possible.

Counts are added per task and language before they are shuffled by (language, n-gram); the ranks of a language
are limited per partition before its best n-grams come together, so a frequent language costs no more than another. Profiles are
``TOP`` rows per language; they go to the driver and the tasks in chunks of ``CHUNK`` languages, and rows keep the nearest so far, so
any number of languages works.

Defined results: texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing was learned. A
null ``doc_id`` belongs to the training part. Repeated rows count, and are answered once each. Long texts are counted whole, in pieces of
``PIECE`` characters; others are counted together, ``GROUP`` characters at a time. An empty table gives no rows. Only ``doc_id``, ``text`` and ``lang`` are read, the last for training only.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import store

#: Ranks of a profile.
TOP = 400
#: Languages of which the profiles are compared together.
CHUNK = 500
PIECE = 1 << 20
#: Characters and texts that are counted together, and numbers of n-grams up to which a table of all of them is used.
GROUP, GROUP_TEXTS, DENSE = 1 << 17, 2000, 1 << 22
#: Distinct n-grams of a language that a task holds before it hands them on, and n-grams held uncounted.
HELD, PENDING = 1 << 20, 1 << 22
UNKNOWN = "und"

_BITS = np.uint64(21)  # of a code point
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letter" not in _tables:
        _tables["letter"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _tables["letter"]


def _points(text: str) -> np.ndarray:
    """Code points of a text as n-grams see it; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[0] |= True
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    points = points[keep]
    return np.pad(points, (int(points[0] != 32), int(points[-1] != 32)), constant_values=32).astype(np.uint64)


def _keys(points: np.ndarray) -> np.ndarray:
    """All n-grams as numbers, one to three code points each."""
    two = points[:-1] << _BITS | points[1:]
    three = two[:-1] << _BITS | points[2:]
    return np.concatenate([points[points != 32], two, three])


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, sorted; how often each occurs)."""
    points = _points(text) if text else np.empty(0, np.uint64)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(points) <= PIECE:
        return _counted(_keys(points))
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for a in range(0, len(points), PIECE):
        # n-grams that begin in the piece: those of it and two more, less those of these two
        new, n = _counted(_keys(points[a : a + PIECE + 2]))
        over = points[a + PIECE : a + PIECE + 2]
        if len(over):
            less, m = _counted(_keys(over))
            n[np.searchsorted(new, less)] -= m
        keys, counts = _counted(np.concatenate([keys, new]), np.concatenate([counts, n]))
    return keys[counts > 0], counts[counts > 0]


def _groups(texts: list):
    """Places of ``texts`` that are counted together, as (begin, end); a text longer than a piece is alone."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > begin and (size + n > min(GROUP, PIECE) or k - begin >= GROUP_TEXTS):
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _alone(texts: list) -> bool:
    return len(texts) == 1 and len(texts[0] or "") > PIECE


class Grams:
    """The n-grams of some texts, numbered 0 .. ``size`` in the order of their keys by the ``letters`` that occur."""

    def __init__(self, texts: list):
        texts = [f" {t.lower()} " if t else " " for t in texts]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        points, starts = points.astype(np.int64), np.cumsum(sizes) - sizes
        seen = np.zeros(max(32, int(points.max(initial=0))) + 1, bool)
        seen[points] = True
        seen &= _letters()[: len(seen)]
        seen[32] = True
        self.letters = np.flatnonzero(seen)
        k = self.k = len(self.letters)
        self.size = k + k * k + k * k * k
        self.blank = int(np.searchsorted(self.letters, 32))
        rank = np.full(len(seen), self.blank)
        rank[self.letters] = np.arange(k)
        points = rank[points]
        letter = points != self.blank
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[starts] = True  # texts meet in two spaces, which occur nowhere else
        self.starts = np.cumsum(keep)[starts] - 1
        self.points = points[keep]

    def numbers(self) -> np.ndarray:
        """Numbers of all sequences of one to three points, those that are no n-grams among them."""
        x, k, n = self.points, self.k, len(self.points)
        out = np.empty(n + max(n - 1, 0) + max(n - 2, 0), np.int64)
        out[:n] = x
        two = x[:-1] * k
        two += x[1:]
        np.add(two, k, out=out[n : n + len(two)])
        three = two[:-1] * k
        three += x[2:]
        np.add(three, k + k * k, out=out[n + len(two) :])
        return out

    def none(self) -> np.ndarray:
        """Numbers of what is no n-gram: a space alone, and whatever has two spaces side by side."""
        k, b = self.k, self.blank
        pair, all_ = b * k + b, np.arange(k)
        return np.concatenate([[b, k + pair], k + k * k + pair * k + all_, k + k * k + all_ * k * k + pair])

    def texts(self) -> np.ndarray:
        """The text of each of ``numbers``."""
        text = np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=len(self.points)))
        return np.concatenate([text, text[:-1], text[:-2]])

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """Keys of sorted numbers."""
        k, points = self.k, self.letters.astype(np.uint64)
        a, b = np.searchsorted(numbers, [k, k + k * k])
        two, three = numbers[a:b] - k, numbers[b:] - (k + k * k)
        pair = lambda n: points[n // k] << _BITS | points[n % k]
        return np.concatenate([points[numbers[:a]], pair(two), pair(three // k) << _BITS | points[three % k]])

    def of_keys(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the sorted keys that have a number, their numbers)."""
        k, mask = self.k, np.uint64((1 << 21) - 1)
        a, b = np.searchsorted(keys, np.array([1, 1 << 21], np.uint64) << _BITS)
        rank = np.full(int(self.letters[-1]) + 2, -1)
        rank[self.letters] = np.arange(k)
        at = [rank[np.minimum((keys >> np.uint64(21 * n)) & mask, np.uint64(len(rank) - 1))] for n in (2, 1, 0)]
        numbers = (at[0] * k + at[1]) * k + at[2] + (k + k * k)
        numbers[a:b] = at[1][a:b] * k + at[2][a:b] + k
        numbers[:a] = at[2][:a]
        known = at[2] >= 0
        known[a:] &= at[1][a:] >= 0
        known[b:] &= at[0][b:] >= 0
        return np.flatnonzero(known), numbers[known]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct n-grams of all texts, sorted; how often each occurs)."""
        numbers = self.numbers()
        if self.size > DENSE:
            numbers, counts = np.unique(numbers, return_counts=True)
            ok = ~np.isin(numbers, self.none())
            numbers, counts = numbers[ok], counts[ok]
        else:
            counts = np.bincount(numbers, minlength=self.size)
            counts[self.none()] = 0
            numbers = np.flatnonzero(counts)
            counts = counts[numbers]
        return self.keys(numbers), counts

    def profiles(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, rank, number) of the ``top`` most frequent n-grams of each text, by text and rank."""
        numbers, n = self.numbers(), len(self.starts)
        if self.size <= DENSE:  # numbered anew by those that occur, so that a table of all texts is small
            seen = np.zeros(self.size, bool)
            seen[numbers] = True
            seen[self.none()] = False
            known = np.flatnonzero(seen)
            width = len(known) + 1
            place = np.full(self.size, len(known))
            place[known] = np.arange(len(known))
            cells = self.texts()
            cells *= width
            cells += place[numbers]
            counts = np.bincount(cells, minlength=n * width)
            counts[len(known) :: width] = 0
            cells = np.flatnonzero(counts)
            counts = counts[cells]
            text, cells = np.divmod(cells, width)
            numbers = known[cells]
        else:
            cells, counts = np.unique(self.texts() * self.size + numbers, return_counts=True)
            text, numbers = np.divmod(cells, self.size)
            ok = ~np.isin(numbers, self.none())
            text, numbers, counts = text[ok], numbers[ok], counts[ok]
        most, bits = int(counts.max(initial=0)), len(text).bit_length()
        # numbers of a text ascend, so equal counts stay in order by place
        order = np.sort((text * (most + 1) + most - counts) << bits | np.arange(len(text))) & ((1 << bits) - 1)
        rank = np.arange(len(text)) - np.searchsorted(text, np.arange(n))[text]
        best = rank < top
        return text[best], rank[best], numbers[order[best]]


def _count_grams(batches):
    """Batches (lang, text) -> (lang, gram, n), added up per task as far as they fit."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    fresh_keys: dict[str, list] = defaultdict(list)
    totals: dict[str, tuple] = {}
    pending = held = 0

    def settle():
        for lang, parts in fresh_keys.items():
            keys, counts = totals.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            totals[lang] = _counted(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([counts, *(n for _, n in parts)]))
        fresh_keys.clear()

    def flush():
        for lang, (keys, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], schema=schema)
        totals.clear()

    for batch in batches:
        by_lang: dict[str, list] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            for a, b in _groups(texts):
                keys, counts = ngrams(texts[a]) if _alone(texts[a:b]) else Grams(texts[a:b]).counted()
                if len(keys):
                    fresh_keys[lang].append((keys, counts))
                    pending += len(keys)
                if pending >= PENDING:
                    settle()
                    pending, held = 0, sum(len(k) for k, _ in totals.values())
                    if held >= HELD:
                        yield from flush()
    settle()
    yield from flush()


def learn_profiles(docs: DataFrame, usable: Column, top: int = TOP) -> DataFrame:
    """``docs(lang, text)`` -> ``(lang, gram, place)``, ranks from 0, of the rows where ``usable`` holds."""
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    counts = known.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """Rank tables of some languages: the n-grams of any of them, sorted, and per language the rank of each."""

    def __init__(self, rows, top: int):
        self.top = top
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.uint64))
        # a column more for the n-grams that none of them has
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), 2 * top, np.int32)
        where = {lang: k for k, lang in enumerate(self.langs)}
        for r in rows:
            self.ranks[where[r["lang"]], np.searchsorted(self.grams, np.uint64(r["gram"]))] = r["place"]

    def nearest(self, text: str) -> tuple[str, float] | None:
        """The answer for one text, counted in pieces."""
        keys, counts = ngrams(text)
        if not len(keys):
            return None
        if len(keys) > self.top:
            least = np.partition(counts, len(counts) - self.top)[len(counts) - self.top]
            keys, counts = keys[counts >= least], counts[counts >= least]
        keys = keys[np.lexsort((keys, -counts))[: self.top]]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        at = np.where(self.grams[at] == keys, at, len(self.grams))
        best, score = self._closest(at, np.arange(len(keys)), np.zeros(1, int))
        return self.langs[best[0]], float(score[0])

    def _closest(self, at: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) per text, whose n-grams begin at ``first``; ``at`` are their columns of ``ranks``."""
        least = best = None
        rank = rank.astype(np.int32)
        for k, ranks in enumerate(self.ranks):
            away = ranks[at]
            away -= rank
            np.abs(away, out=away)  # the rank of what is lacking is so large that this is TOP or more
            away = np.add.reduceat(np.minimum(away, self.top, out=away), first, dtype=np.int64)
            if best is None:
                least, best = away, np.zeros(len(first), int)
            else:
                nearer = away < least
                least[nearer], best[nearer] = away[nearer], k
        return best, 1 - least / (self.top * np.diff(first, append=len(at)))

    def nearest_of(self, texts: list) -> list[tuple[str, float] | None]:
        """The answers for some texts, counted together."""
        out: list = [None] * len(texts)
        grams = Grams(texts)
        text, rank, numbers = grams.profiles(self.top)
        if not len(text):
            return out
        columns, known = grams.of_keys(self.grams)
        if grams.size <= DENSE:
            table = np.full(grams.size, len(self.grams), np.int64)
            table[known] = columns
            at = table[numbers]
        else:
            columns, known = np.append(columns, len(self.grams)), np.append(known, grams.size)
            place = np.searchsorted(known, numbers)
            at = np.where(known[place] == numbers, columns[place], len(self.grams))
        first = np.flatnonzero(rank == 0)
        for t, best, score in zip(text[first].tolist(), *(x.tolist() for x in self._closest(at, rank, first))):
            out[t] = self.langs[best], score
        return out


def _predict(profiles: Profiles, text: int, lang: int, score: int):
    def run(batches):
        for batch in batches:
            langs, scores, texts = (batch.column(k).to_pylist() for k in (lang, score, text))
            for a, b in _groups(texts):
                answers = [profiles.nearest(texts[a])] if _alone(texts[a:b]) else profiles.nearest_of(texts[a:b])
                for k, found in enumerate(answers, a):
                    if found and (langs[k] == UNKNOWN or (-found[1], found[0]) < (-scores[k], langs[k])):
                        langs[k], scores[k] = found
            columns = list(batch.columns)
            columns[lang], columns[score] = pa.array(langs, pa.string()), pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def identify(docs: DataFrame, profiles: DataFrame, keep: list[str], top: int = TOP) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of each row of ``docs(text, ...)``; needs stored ``profiles``."""
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    rows = rows.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    place = {c: k for k, c in enumerate(rows.columns)}
    last = None
    while True:
        # at most CHUNK languages with TOP n-grams each
        langs = profiles.select("lang").distinct().filter(F.lit(True) if last is None else F.col("lang") > last).orderBy("lang").limit(CHUNK)
        chunk = profiles.join(langs, "lang").collect()
        if not chunk:
            return rows.select(*keep, "lang_pred", "score")
        last = max(r["lang"] for r in chunk)
        rows = rows.mapInArrow(_predict(Profiles(chunk, top), place["text"], place["lang_pred"], place["score"]), rows.schema)


def predict_languages(docs: DataFrame, usable: Column, top: int = TOP) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``(doc_id, lang_pred, score)``; learns where ``usable`` holds."""
    return identify(docs, store(learn_profiles(docs, usable, top)), ["doc_id"], top)
