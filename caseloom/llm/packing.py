"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Documents become token ids in one pass over the texts. Only documents longer than a sequence are cut. What is
shuffled afterwards is one small row per piece. Pieces are dealt by hash to cells of about ``CELL`` pieces; each
cell is packed on its own, so a task's memory does not depend on the corpus, and a cell leaves at most one
sequence that better company could have filled.

In a cell, each sequence is filled greedily with the longest pieces that fit. Then its smallest piece is replaced
by the two unpacked pieces that fill the enlarged gap most tightly, if that leaves less space than before.

Defined results: a null or empty text is one piece of one id (the end id). Repeated rows are packed once each. An
empty table gives no rows. Only ``doc_id`` and ``text`` are read, so further columns do not matter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import store

#: Pieces of one cell, about.
CELL = 50_000
#: Known chunks, and known words, that one task remembers with their ids; above it the memory is emptied and refilled.
REMEMBERED, REMEMBERED_WORDS = 1_000_000, 1_000_000
#: Characters that normalising only lower-cases, one for one; what is none of them, or may begin a special token.
PLAIN = [c for c in map(chr, range(0x180)) if c != "\u0130"]
ODD = re.compile("[^\0-\u017f]|\u0130|<\\|")
#: What the tokenizer does to a text before it looks for tokens; words of plain characters are cut by this pattern.
STEPS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _plain(kind: str) -> str:
    return "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)


WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_plain('L')}]+|[{_plain('N')}]|[^\t-\r \x85\xa0{_plain('L')}{_plain('N')}]+")
#: Bytes of text that are split at once, about.
STRETCH = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids as little-endian bytes.

    The tokenizer never joins text across ASCII white space, so a text's ids are those of its chunks in turn, and
    chunks seen before need no new call. New chunks of plain characters are lower-cased and cut into words as the
    tokenizer does it, so that it meets each word once, however it is written and whatever stands beside it. The encoder
    is broadcast, so a worker process keeps what it knows from task to task.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary, self.tokenizer, self.known, self.words = vocabulary, None, {}, {}

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "tokenizer": None, "known": {}, "words": {}}

    def _start(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Sequence, WhitespaceSplit

        self.tokenizer, self.merger = Tokenizer.from_str(self.vocabulary), Tokenizer.from_str(self.vocabulary)
        steps = json.loads(self.vocabulary)
        normal, split = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}
        self.cuts = normal.get("normalizers", []) + split.get("pretokenizers", []) == STEPS
        if self.cuts:  # the merger gets words, with a space between them
            self.merger.normalizer = None
            self.merger.pre_tokenizer = Sequence([WhitespaceSplit(), self.tokenizer.pre_tokenizer[1]])
        tokens = self.tokenizer.get_vocab()
        self.size = np.zeros(max(tokens.values()) + 1, np.int64)  # bytes that each token stands for
        for token, number in tokens.items():
            self.size[number] = len(token.removesuffix("</w>"))

    def _encode_each(self, texts: list[str], tokenizer=None) -> list[bytes]:
        tokenizer = tokenizer or self.tokenizer
        return [array("I", f.ids).tobytes() for f in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """All words in one call; token lengths tell where each ends. If they do not fit, one by one."""
        text = " ".join(words)
        ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.cumsum(self.size[ids])
        ends = np.cumsum(np.fromiter(map(len, text.encode().split(b" ")), np.int64, len(words)))
        last = np.searchsorted(at, ends)
        if len(ids) and last[-1] == len(ids) - 1 and (at[last] == ends).all():
            data, cuts = ids.tobytes(), (4 * (last + 1)).tolist()
            return [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return self._encode_each(words, self.merger)

    def _encode_plain(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(WORD.findall, " ".join(chunks).lower().split(" ")))
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        new = list(set().union(*cut).difference(self.words))
        if new:
            self.words.update(zip(new, self._encode_words(new)))
        get = self.words.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = list(map(self.known.get, chunks))
        new = [k for k, ids in enumerate(found) if ids is None]
        odd = [k for k in new if not self.cuts or ODD.search(chunks[k])]
        plain = sorted(set(new).difference(odd)) if odd else new
        for some, encode in ((plain, self._encode_plain), (odd, self._encode_each)):
            texts = [chunks[k] for k in some]
            for k, text, ids in zip(some, texts, encode(texts) if some else ()):
                self.known[text] = found[k] = ids
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        if self.tokenizer is None:
            self._start()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = split.flatten().dictionary_encode()
        ids = pa.array(self._encode(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        at = np.append(np.cumsum(pc.binary_length(ids)), 0)  # the last is where the first begins
        ends = at[np.cumsum(pc.list_value_length(split)) - 1].tolist()
        data = bytes(ids.buffers()[2] or b"")
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def pieces_of(encoder, length: int, end: int):
    def run(batches):
        encode, last = encoder.value, np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            stretch = np.cumsum(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64) // STRETCH
            cuts = [*np.flatnonzero(np.diff(stretch, prepend=-1)).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                out = []
                for doc, data in zip(ids[a:b], encode(texts.slice(a, b - a))):
                    data += last
                    for k, at in enumerate(range(0, len(data), 4 * length)):
                        part = data[at : at + 4 * length]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def best_two_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``; every position occurs once."""
    order = np.argsort(lengths, kind="stable")
    sizes = np.asarray(lengths)[order]
    count = np.bincount(sizes, minlength=room + 1)
    first = np.concatenate([[0], np.cumsum(count)])[: room + 1]
    upto = np.maximum.accumulate(np.where(count > 0, np.arange(room + 1), 0))  # longest present length up to x, 0: none

    def take(x: int) -> None:
        count[x] -= 1
        if not count[x]:
            above = np.argmax(upto[x:] != x) if upto[-1] != x else room + 1 - x
            upto[x : x + above] = upto[x - 1]

    def give(x: int) -> None:
        count[x] += 1
        if count[x] == 1:
            part = upto[x:]
            part[part < x] = x

    bins = []
    while upto[-1]:
        inside, gap = [], room
        while gap and (x := int(upto[gap])):
            n = min(gap // x, int(count[x]))
            for _ in range(n):
                take(x)
            inside += [x] * n
            gap -= x * n
        if gap and inside and upto[-1]:
            least = inside[-1]
            target = gap + least
            a = np.flatnonzero(count[: target + 1])
            a = a[a > 0]
            if len(a):
                b = upto[target - a]
                same = (b == a) & (count[a] < 2)
                b[same] = upto[a[same] - 1]
                total = np.where(b > 0, a + b, 0)
                k = int(np.argmax(total))
                if total[k] > least:
                    pair = int(a[k]), int(b[k])
                    inside.pop()
                    for x in pair:
                        take(x)
                    give(least)
                    inside += pair
        bins.append(inside)
    used = first.copy()
    out = []
    for inside in bins:
        row = []
        for x in inside:
            row.append(int(order[used[x]]))
            used[x] += 1
        out.append(row)
    return out


def _pack_cell(room: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, row in enumerate(best_two_fit(lengths, room)):
            at = np.cumsum(lengths[row])
            sequence[row] = (int(key[0]) << 32) + k
            offset[row] = at - lengths[row]
        return pdf.drop(columns="cell").assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, vocabulary_path: str, length: int = 4096, end: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece with its sequence and place.

    ``vocabulary_path``: a tokenizer file that the driver can read; its few megabytes are broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        encoder = spark.sparkContext.broadcast(Encoder(f.read()))
    pieces = store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces_of(encoder, length, end), PIECES))
    cells = max(1, round(pieces.count() / CELL))
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells))
    return pieces.withColumn("cell", cell).groupBy("cell").applyInPandas(_pack_cell(length), PIECES + ", sequence_id long, offset long")
