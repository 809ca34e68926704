"""Operator 9: repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text (its 16 bits depend on the last 16
bytes).  A text is cut before the word with the least hash, the first of equal
ones, of each ``CUT_WORDS`` words in a row: no stretch of so many words is without
a cut, repeated words included (those are cut once a period).  Cut points depend
on what stands around them alone, so an insertion moves no other cut.

Between two texts that share a passage, the cuts differ within its first
``CUT_WORDS`` + 7 words (8 words fill the hash, as a word and its blank have two
bytes) and its last ``CUT_WORDS`` at most.  So every shared passage of
``min_words`` + 2 ``CUT_WORDS`` + 7 words (50) is found; one of fewer words may be
missed, and up to 16 words at its start and 9 at its end stay.

A window is a run of
chunks with just ``min_words`` words or more, known by a 64-bit digest of its
chunks' digests.  A window that an earlier document (by id) holds as well is
repeated; what repeated windows cover is a repeated passage, which the later
document loses.  So each passage rests on ``min_words`` words in a row of one
earlier document, not on chunks that recur here and there.

The windows' table is written once; digests are counted with map-side
combination (smallest and largest id), and only digests that two documents hold
are joined back.  A window that stands in one document more than once (a line said
over and over) is counted and joined once for it and marked wherever it stands.
Two different windows have the same digest with a chance of 2^-64.

Defined results: words are runs of bytes above a blank (text in a script without
blanks is one word).  Null and empty texts have no chunk.  Repeats within one
document stay.  Rows with the same id are one document; rows without an id
neither lose nor take part.  An empty table gives an empty result.  Other
columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: A passage of 50 words or more holds whole chunks with at least half of its words.
MIN_WORDS = 25
CUT_WORDS = 9
SEED = 11
CHUNK_BYTES = 1 << 18
_PAD = bytes(16)

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 16, size=256, dtype=np.uint16)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash modulo 2^16 at each byte: sum of G[b] shifted by its distance."""
    h = _GEAR[data]
    for reach in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[reach:] = h[:-reach] << np.uint16(reach)
        h = h + moved
    return h


def chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(digests, ends, words) of each text's chunks; ends in code points."""
    data = np.frombuffer(b"".join(_PAD + t for t in texts) + b"\0", dtype=np.uint8)
    n = len(data) - 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes + len(_PAD)) - sizes
    inside = np.ones(n + 1, dtype=bool)
    inside[n] = False
    for p in first.tolist():
        inside[p - len(_PAD):p] = False
    blank = data[:n] <= 32
    begins = ~blank & np.concatenate(([True], blank[:-1]))
    # A cut stands before a word, within a text.
    at = np.flatnonzero(begins[1:] & inside[:n - 1] & inside[1:n]) + 1
    last = np.flatnonzero(inside[:n] & ~inside[1:]) + 1  # the end of each non-empty text
    begin = first[sizes > 0]
    text_of = np.searchsorted(first, at, side="right") - 1
    least = np.zeros(0, dtype=np.int64)
    if len(at) >= CUT_WORDS:
        seen = np.lib.stride_tricks.sliding_window_view(gear(data[:n])[at - 1], CUT_WORDS)
        least = (np.arange(len(seen)) + seen.argmin(axis=1))[text_of[:len(seen)] == text_of[CUT_WORDS - 1:]]
    cut = np.unique(np.concatenate((at[least], last)))
    start = np.concatenate((begin, cut[~np.isin(cut, last, assume_unique=True)]))
    start.sort()
    power = np.full(n + 1, _ODD)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(n + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    back[0] = 1
    np.cumprod(back, out=back)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data[:n].astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    digest = (prefix[cut] - prefix[start]) * back[start] + (cut - start).astype(np.uint64)
    digest = (digest ^ (digest >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    digest ^= digest >> np.uint64(29)
    points = np.concatenate(([0], np.cumsum((data[:n] & 0xC0) != 0x80)))
    word = np.concatenate(([0], np.cumsum(begins)))
    owner = np.searchsorted(first, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    ends, words = points[cut] - points[first[owner]], word[cut] - word[start]
    return [(digest[a:b].view(np.int64), ends[a:b], words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest run from each chunk on, and of the shortest run up to
    each chunk, with ``min_words`` words: any run with so many is covered to both its ends."""
    n, least = len(words), max(min_words, 1)
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    end = np.searchsorted(total, total[:-1] + least)
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    ahead, back = np.flatnonzero(end <= n), np.flatnonzero(first >= 0)
    both = np.unique(np.concatenate((ahead * (n + 1) + end[ahead], first[back] * (n + 1) + back + 1)))
    return both // (n + 1), both % (n + 1)


def window_digests(digests: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of the chunks' digests of each window."""
    n = len(digests)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(digests.view(np.uint64) * _POWER.upto(n), out=prefix[1:])
    digest = (prefix[end] - prefix[first]) * _BACK.upto(n)[first] if n else prefix[:0]
    digest = (digest + (end - first).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    digest ^= digest >> np.uint64(31)
    return (digest * np.uint64(0x94D049BB133111EB)).view(np.int64)


class _Powers:
    """Powers of an odd number modulo 2^64, kept and grown as texts need them."""

    def __init__(self, base: int):
        self.base, self.kept = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.kept) < n:
            self.kept = np.full(2 * n, self.base)
            self.kept[0] = 1
            np.cumprod(self.kept, out=self.kept)
        return self.kept[:n]


_POWER, _BACK = _Powers(int(_ODD)), _Powers(pow(int(_ODD), -1, 1 << 64))


def _once(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which are the first of their digest, pairs in turn of each other's place and its first's)."""
    _, first, of = np.unique(digests, return_index=True, return_inverse=True)
    like = first[of]
    later = np.flatnonzero(like != np.arange(len(digests)))
    return like == np.arange(len(digests)), np.stack((later, like[later]), axis=1).ravel()


def _chunk(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < CHUNK_BYTES and i + 1 < len(texts):
                    continue
                found = chunks(texts[first:i + 1])
                part = batch.slice(first, i + 1 - first)
                digests = [window_digests(x[0], *windows(x[2], min_words)) for x in found]
                once = [_once(d) for d in digests]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([hashlib.md5(t).digest() for t in texts[first:i + 1]], pa.binary()),
                     pa.array([pa.array(d, mask=~o[0]) for d, o in zip(digests, once)], pa.list_(pa.int64())),
                     pa.array([o[1].astype(np.int32) for o in once], pa.list_(pa.int32())),
                     pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32())),
                     pa.array([x[2].astype(np.int32) for x in found], pa.list_(pa.int32()))],
                    names=["row", "id", "text_key", "digests", "again", "ends", "words"])
                first, size = i + 1, 0
    return run


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, ends, words, again, hits, keys = (batch.column(i).to_pylist() for i in range(6))
            for i, marked in enumerate(hits):
                first, end = (x.tolist() for x in windows(np.array(words[i]), min_words))
                owner = {h["pos"]: h["owner"] for h in marked}
                owner |= {k: owner[f] for k, f in zip(again[i][::2], again[i][1::2]) if f in owner}
                marked = sorted((first[k], end[k], x) for k, x in owner.items())
                k = 0
                while k < len(marked):
                    a, b, j = marked[k][0], marked[k][1], k + 1
                    while j < len(marked) and marked[j][0] <= b:
                        b, j = max(b, marked[j][1]), j + 1
                    start = ends[i][a - 1] if a else 0
                    out.append((ids[i], start, ends[i][b - 1], sum(words[i][a:b]), sorted({m[2] for m in marked[k:j]}), keys[i]))
                    k = j
            column = list(zip(*out)) or [()] * 6
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(column[0], kind), pa.array(column[1], pa.int64()), pa.array(column[2], pa.int64()),
                 pa.array(column[3], pa.int64()), pa.array(column[4], pa.list_(kind)), pa.array(column[5], pa.binary())],
                names=["id", "start", "end", "n_words", "first_ids", "text_key"])
    return run


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, start, end, n_words, first_ids, text_key) of the repeated passages."""
    kind = dict(docs.dtypes)[id_col]
    cut = save(docs.filter(F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(_chunk(min_words), f"row long, id {kind}, text_key binary, digests array<long>, again array<int>, ends array<int>, words array<int>"))
    every = cut.select("row", "id", F.posexplode("digests").alias("pos", "digest")).filter("digest is not null")
    shared = (every.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("other"))
              .filter("owner <> other").select("digest", "owner"))
    hits = (every.join(shared, "digest").filter("owner <> id").groupBy("row")
            .agg(F.collect_list(F.struct("pos", "owner")).alias("hits"), F.count(F.lit(1)).alias("n")))
    rows = cut.join(hits, "row").select("id", "ends", "words", "again", "hits", "text_key")
    return rows.mapInArrow(_runs(min_words),
                           f"id {kind}, start long, end long, n_words long, first_ids array<{kind}>, text_key binary")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end, n_words, first_ids): one row for each passage to remove, in code
    points, with the earlier documents that hold its windows."""
    return _repeats(docs, id_col, text_col, min_words).select(F.col("id").alias(id_col), "start", "end", "n_words", "first_ids")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts.  A row loses the
    passages found in its own text, also where its id stands with other texts."""
    spans = _repeats(docs, id_col, text_col, min_words).groupBy(
        F.col("id").alias("__cut_id"), F.lower(F.hex("text_key")).alias("__cut_text")).agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct("start", "end")))).alias("__cut"))
    text = F.col(text_col)
    # What stays: from each passage's end to the next one's start.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cut", lambda s: s["end"]))
    ends = F.concat(F.transform("__cut", lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.concat_ws("", F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substr(
        text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    own = (docs[id_col] == spans["__cut_id"]) & (F.md5(docs[text_col].cast("binary")) == spans["__cut_text"])
    joined = docs.join(spans, own, "left")
    return joined.select(*[F.when(F.col("__cut").isNull(), text).otherwise(kept).alias(c) if c == text_col else docs[c]
                           for c in docs.columns])
