"""Operator 3: benchmark decontamination with a generalised suffix automaton.

The benchmark's items (normalised words) are built into one automaton that
accepts every run of words of any item.  Training tokens stream through it: at
each word it holds the length of the longest run ending there that some item
contains.  A run of ``window`` words or more, or a whole item that is shorter,
is a hit; all its words are marked.  ``clean`` removes the marked spans from
the texts and drops documents of which more than ``max_coverage`` is marked.

A word that no item has, or two neighbours that no item has next to each
other, take the automaton back to its root or to a single word, so runs too
short for any window are skipped with array operations; what is streamed gives
the same lengths as streaming everything.

A benchmark of at most ``BLOCK_WORDS`` words is one automaton, built on the driver
and broadcast, and each text streams through it once.  A larger one is dealt
into blocks of about that size, and ``find_hits`` reads the corpus once for all of them:
a bounded filter of the items' hashed windows (``FILTER_BITS`` at most, broadcast) leaves the texts
that may hold one, the hashes left are joined with the blocks they come from,
and each (document, block) pair meets in a task that builds the block's
automaton; a block that many documents hold is dealt in groups of
``GROUP``.  The hashes only choose pairs; what is marked comes from the automaton.
``clean`` cuts a large benchmark's blocks one after another, with one broadcast
automaton for each: it is meant for benchmarks of a few blocks.  A single item
longer than a block is a block of its own.

Defined results: null or word-less texts have no words and no hits; null or
word-less items have no window; repeated items with different ids all count,
items with null ids count as windows but have no id to list; repeated
documents each get their own row.  An empty benchmark marks nothing.  Extra
columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null, save, text_slices
from .near_dedup import word_hashes

WINDOW = 10
#: Words in one automaton: about 1 kB of memory each.
BLOCK_WORDS = 100_000
#: Share of marked words from which ``clean`` drops a document.
MAX_COVERAGE = 0.5
#: Bits of the filter of hashed windows at most; fewer for benchmarks of few windows.
FILTER_BITS = 1 << 28
PROBES = 8
#: Documents that meet a block in one group.
GROUP = 1024
#: Bytes of text whose words are held at once.
CHUNK_BYTES = 1 << 20

# Word bytes (digits, letters, everything beyond ASCII) stay, A-Z are lowered, the rest become blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Over the words of many items, with what a match needs in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)
        self._mark(coded)
        pairs = {a * len(self.vocabulary) + b for _, c in coded for a, b in zip(c, c[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.likely = np.zeros(1 << 20, dtype=bool)
        self.likely[self._slot(self.pairs)] = True

    @staticmethod
    def _slot(keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # an earlier item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return state

    def _mark(self, coded) -> None:
        """items_at: the items that contain the window ending in a state; short_at: the
        whole short items (length, id) that end there; up_short: nearest state above with some."""
        n = len(self.length)
        self.items_at: dict[int, set] = {}
        self.short_at: dict[int, tuple[int, set]] = {}
        for item, code in coded:
            s = size = 0
            for c in code:
                # Keep to the state of the last ``window`` words.
                s, size = self.step[s][c], size + 1
                if size > self.window:
                    size = self.window
                while self.length[self.link[s]] >= size:
                    s = self.link[s]
                if size == self.window:
                    self.items_at.setdefault(s, set()).add(item)
            if len(code) < self.window:
                self.short_at.setdefault(s, (len(code), set()))[1].add(item)
        self.up_short = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.up_short[s] = up if up in self.short_at else self.up_short[up]

    def candidates(self, codes: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """Runs of ``codes`` (-1: no item's word) long enough for a window, within one row."""
        if len(codes) == 0 or not self.vocabulary:
            return []
        if self.shortest < 2:
            linked = (codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:])
        else:
            at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:]))
            keys = codes[at].astype(np.int64) * len(self.vocabulary) + codes[at + 1]
            maybe = self.likely[self._slot(keys)]
            at, keys = at[maybe], keys[maybe]
            if len(self.pairs):
                found = self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
            else:
                found = np.zeros(len(keys), dtype=bool)
            linked = np.zeros(len(codes) - 1, dtype=bool)
            linked[at[found]] = True
        # A run begins at a known word that is not linked to the one before.
        starts = np.flatnonzero((codes >= 0) & ~np.concatenate(([False], linked)))
        ends = np.flatnonzero((codes >= 0) & ~np.concatenate((linked, [False]))) + 1
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, set]]:
        """(start, end, items) of the hits of one run, end exclusive."""
        s = size = 0
        for i, c in enumerate(codes):
            while s and c not in self.step[s]:
                s = self.link[s]
                size = self.length[s]
            s = self.step[s].get(c, 0)
            size = size + 1 if s else 0
            if size >= self.window:
                t = s
                while self.length[self.link[t]] >= self.window:
                    t = self.link[t]
                yield i + 1 - size, i + 1, self.items_at[t]
            t = s if s in self.short_at else self.up_short[s]
            while t > 0:
                length, items = self.short_at[t]
                if length <= size:
                    yield i + 1 - length, i + 1, items
                t = self.up_short[t]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: list[bytes | None], automaton: SuffixAutomaton) -> list[tuple[int, list[tuple[int, int]], set]]:
    """(words, marked word spans, item ids) of each text."""
    out: list = [None] * len(texts)
    at = 0
    while at < len(texts):
        first, size, words, counts = at, 0, [], []
        while at < len(texts) and (at == first or size < CHUNK_BYTES):
            own = words_of(texts[at] or b"")
            counts.append(len(own))
            words += own
            size += len(texts[at] or b"")
            at += 1
        codes = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        starts = np.concatenate(([0], np.cumsum(counts)))
        row = np.repeat(np.arange(len(counts)), counts)
        hits: dict[int, tuple[list, set]] = {}
        for a, b in automaton.candidates(codes, row):
            r = int(row[a])
            for i, j, items in automaton.stream(codes[a:b].tolist()):
                own = hits.setdefault(r, ([], set()))
                own[0].append((a + i - int(starts[r]), a + j - int(starts[r])))
                own[1].update(items)
        for r, n in enumerate(counts):
            spans, items = hits.get(r, ([], set()))
            out[first + r] = (n, union(spans), items)
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The items in lists of bounded size, fetched one partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), empty_if_null(text_col).cast("binary")).toLocalIterator()
    block, size = [], 0
    for item, text in rows:
        words = words_of(bytes(text))
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


def broadcast_automaton(spark, block: list, window: int):
    """Pickled with its class, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(SuffixAutomaton(block, window)))


def _scan_batches(automaton, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(automaton.value)
        for batch in batches:
            found = scan(batch.column(batch.schema.get_field_index(text)).to_pylist(), own)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[x for s in spans for x in s] for _, spans, _ in found], pa.list_(pa.int64())),
                        pa.array([sorted(i for i in items if i is not None) for _, _, items in found], pa.list_(pa.string())),
                        pa.array([len(items) > 0 for _, _, items in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__words", "__spans", "__items", "__hit"])
    return run


def _windows(texts: list[bytes], lengths: list[int]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, {length: (hashes, their texts' numbers)}) of all windows."""
    words, counts = word_hashes([t.translate(_TABLE) for t in texts])
    text_of = np.repeat(np.arange(len(texts)), counts)
    out = {}
    for k in lengths:
        n = max(len(words) - k + 1, 0)
        h = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = text_of[:n] == text_of[k - 1:k - 1 + n]
        out[k] = h[whole], text_of[:n][whole]
    return counts, out


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` places in a filter of 2^``bits`` for each hash, one row each."""
    step = (h * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits) for i in range(PROBES)])


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            counts, every = _windows(texts, list(range(1, window + 1)))
            block = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for k, (h, of) in every.items():
                own = np.ones(len(h), bool) if k == window else counts[of] == k
                yield pa.RecordBatch.from_arrays([pa.array(block[of[own]]), pa.array(np.full(int(own.sum()), k, dtype=np.int32)),
                                                  pa.array(h[own].view(np.int64))], names=["block", "length", "hash"])
    return run


def _places(bits: int):
    """Window hashes → the filter's 64-bit words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _probes(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(
                (np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["place", "bit"])
    return run


def _likely(filter_words, bits: int, lengths: list[int]):
    """(row, id, words, hashes that the filter lets through, the text if there are any)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.frombuffer(filter_words.value, dtype=np.uint64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < CHUNK_BYTES and i + 1 < len(texts):
                    continue
                own = texts[first:i + 1]
                counts, every = _windows(own, lengths)
                met: list[list] = [[] for _ in own]
                for h, of in every.values():
                    alive = np.arange(len(h))
                    for at in _probes(h, bits):
                        at = at[alive]
                        alive = alive[(kept[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                    for k, x in zip(of[alive].tolist(), h[alive].view(np.int64).tolist()):
                        met[k].append(x)
                part = batch.slice(first, len(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts.astype(np.int64)), pa.array([sorted(set(m)) for m in met], pa.list_(pa.int64())),
                     pa.array([t if m else None for t, m in zip(own, met)], pa.binary())],
                    names=["__row", "__id", "__words", "__likely", "__text"])
                first, size = i + 1, 0
    return run


def _scan_pairs(window: int):
    """One group of documents against one block."""
    def run(texts: pa.Table, items: pa.Table) -> pa.Table:
        found = []
        if texts.num_rows and items.num_rows:
            own = SuffixAutomaton([(i, words_of(t)) for i, t in zip(items["item"].to_pylist(), items["item_text"].to_pylist())], window)
            found = scan(texts["__text"].to_pylist(), own)
        return pa.table({"__row": texts["__row"] if texts.num_rows else pa.array([], pa.int64()),
                         "__spans": pa.array([[x for s in spans for x in s] for _, spans, _ in found], pa.list_(pa.int64())),
                         "__items": pa.array([sorted(i for i in own_items if i is not None) for _, _, own_items in found], pa.list_(pa.string()))})
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [union([(m[i], m[i + 1]) for m in many for i in range(0, len(m), 2)]) for many in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x for s in own for x in s] for own in spans], pa.list_(pa.int64())),
                                          batch.column(2)], names=["__row", "__spans", "__items"])


def _find_in_blocks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
                    window: int, block_words: int) -> DataFrame:
    spark = docs.sparkSession
    text = empty_if_null(item_text_col)
    listed = benchmark.select(F.col(item_col).cast("string").alias("item"), text.cast("binary").alias("item_text"),
                              F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("words"))
    n_blocks = int(-(-listed.agg(F.sum("words")).first()[0] // block_words))
    items = save(listed.filter("words > 0").select("item", "item_text", F.pmod(F.xxhash64("item", "item_text"), F.lit(n_blocks)).alias("block")))
    known = save(items.select("block", "item_text").mapInArrow(_item_windows(window), "block long, length int, hash long").distinct())
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # window of them at most
    bits = min(max(16, (24 * known.count()).bit_length()), FILTER_BITS.bit_length() - 1)
    words = (known.select("hash").mapInArrow(_places(bits), "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits"))
             .toArrow())  # 2^bits / 64 rows at most
    filled = np.zeros(1 << (bits - 6), dtype=np.int64)
    filled[words["place"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(filled.tobytes())
    kind = dict(docs.dtypes)[id_col]
    base = save(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
                .mapInArrow(_likely(shared, bits, lengths), f"__row long, __id {kind}, __words long, __likely array<long>, __text binary"))
    pairs = save(base.select("__row", F.explode("__likely").alias("hash")).join(known.select("hash", "block").distinct(), "hash")
                 .select("__row", "block").distinct())
    load = F.broadcast(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")))  # one row for each block
    texts = (pairs.join(load, "block").withColumn("part", F.pmod(F.xxhash64("__row"), F.col("groups")))
             .join(base.select("__row", "__text"), "__row").select("block", "part", "__row", "__text"))
    dealt = (items.join(load, "block").select(F.col("block").alias("of_block"), "item", "item_text",
                                              F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("of_part")))
    found = (texts.groupBy("block", "part").cogroup(dealt.groupBy("of_block", "of_part"))
             .applyInArrow(_scan_pairs(window), "__row long, __spans array<long>, __items array<string>"))
    merged = (found.groupBy("__row").agg(F.collect_list("__spans").alias("__all"),
                                         F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
              .mapInArrow(_merged, "__row long, __spans array<long>, __items array<string>"))
    none = F.array()
    return base.select("__row", "__id", "__words").join(merged, "__row", "left").select(
        F.col("__id").alias(id_col), F.col("__words").alias("n_words"), F.coalesce("__spans", none.cast("array<long>")).alias("spans"),
        F.coalesce("__items", none.cast("array<string>")).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, spans, items) for each document: spans of marked words, flat
    (start, end, start, end, ...), and the sorted ids of the items found."""
    parts = blocks(benchmark, item_col, item_text_col, block_words)
    first = next(parts)
    if next(parts, None) is not None:
        return _find_in_blocks(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_words)
    base = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"),
                       F.col(text_col).cast("binary").alias("__text"))
    kind = dict(base.dtypes)["__id"]
    found = base.mapInArrow(_scan_batches(broadcast_automaton(docs.sparkSession, first, window), ["__id", "__row"], "__text"),
                            f"__id {kind}, __row long, __words long, __spans array<long>, __items array<string>, __hit boolean")
    return found.select(F.col("__id").alias(id_col), F.col("__words").alias("n_words"),
                        F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def n_marked(spans: str = "spans"):
    """Words inside the spans."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with marked spans cut out of the texts, all other columns as they
    are; documents marked beyond ``max_coverage`` are dropped.  Blocks are cut
    one after another; a cut never joins two words, but may bring an item's
    words together, so each block's scan repeats on a cut text until nothing is
    found."""
    spark, schema = docs.sparkSession, docs.schema
    at = docs.columns.index(text_col)

    def cleaner(automaton):
        def run(batches):
            own = pickle.loads(automaton.value)
            for batch in text_slices(batches, at, CHUNK_BYTES):
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), dtype=bool)
                changed = False
                for i, (n, spans, _) in enumerate(scan([None if t is None else t.encode() for t in texts], own)):
                    marked = sum(b - a for a, b in spans)
                    if not marked:
                        continue
                    if marked > max_coverage * n:
                        keep[i] = False
                        continue
                    changed = True
                    while spans:
                        texts[i] = cut(texts[i], spans)
                        spans = scan([texts[i].encode()], own)[0][1]
                if changed:
                    columns = list(batch.columns)
                    columns[at] = pa.array(texts, batch.schema.field(at).type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch if keep.all() else batch.filter(pa.array(keep))
        return run

    for block in blocks(benchmark, item_col, item_text_col, block_words):
        automaton = broadcast_automaton(spark, block, window)
        docs = docs.mapInArrow(cleaner(automaton), schema)
    return docs


def items_digest(items: str = "items"):
    return F.sha2(F.concat_ws(",", F.col(items)).cast("binary"), 256)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract row by row, for tests: (id, words, marked, items, digest)."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        ws = words_of((text or "").encode())
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[i:i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, marked, found = words_of((text or "").encode()), set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                if own := windows.get(tuple(ws[i:i + size])):
                    marked.update(range(i, i + size))
                    found |= own
        names = sorted(found)
        out.append((doc, len(ws), len(marked), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


ORACLE = r"""
with w as (
  select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
t as materialized (
  select side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from w),
item_windows as materialized (
  select id as item_id, least(10, len(ws)) as size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as win
  from (select id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from t where side = 'b' and len(ws) > 0)),
doc_windows as (
  select id, size, i, array_to_string(ws[i:i + size - 1], ' ') as win
  from (select id, ws, size, unnest(range(1, len(ws) - size + 2)) as i
        from t, (select distinct size from item_windows) where side = 'd' and len(ws) >= size)),
hits as materialized (
  select distinct id, i, size, item_id from doc_windows join item_windows using (size, win)),
places as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + size)) as p from hits) group by id),
names as (select id, count(*) as n_items, string_agg(name, ',' order by name) as names
          from (select distinct id, item_id::varchar as name from hits) group by id)
select t.id as doc_id, len(t.ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from t left join places using (id) left join names using (id) where side = 'd'
"""
