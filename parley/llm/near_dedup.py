"""Operator 2: near duplicates by MinHash with sequential Bayesian verification.

A document is the set of its distinct word shingles; documents are linked when
the Jaccard similarity of their sets is at least ``threshold``, and linked
documents form one group (connected components).

1. One pass over the texts gives each document's set size, a digest of its set,
   a signature of 160 MinHash values and 32 band keys of 5 values each.  A pair
   at similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6.
2. Documents with the same set are one class; from here on only one
   representative of each class takes part.
3. Candidates come from band buckets without listing a bucket's pairs.  A
   bucket's pivot is its member of the least hash.  First each class meets the
   pivot of its largest bucket, then the pivot of each bucket whose component it
   is not yet in.  What is left of a bucket are pairs of members in different
   components: if they are at most ``LINEAR`` times its members, the members outside
   the largest component are joined with all; else these two sides are compared
   in blocks of at most ``BLOCK`` by ``BLOCK`` members, each pair in the first
   bucket it shares, and only verified links leave a block.  The bulk of a group
   of copies falls into one component in the first steps, so blocks are made of
   the few others against the rest.  No candidate pair is left out.
   Figures of a hot bucket reach its rows by a broadcast of fewer than
   ``HOT_KEYS`` rows, so no task meets a whole hot bucket.
4. A candidate pair's signatures are compared in batches of 32 values.  After n
   values with m matches the posterior probability (uniform prior) that the
   similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m); the
   pair is dropped once that is below ``MISS``.
5. Survivors are verified exactly on the full sets of both texts.

Set elements are 64-bit hashes of shingles.

Defined results: a text with fewer words than a shingle is one element, its
whole sequence; null texts and texts without words have an empty set, link with
nothing and are groups of their own.  Repeated rows and equal texts are linked.
A null id never names a group unless all its members' are null, and a document
without an id is never dropped.  An empty table gives an empty result.  Other
columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, text_slices
from .components import components

#: General default; the registered query sets two-word shingles.
SHINGLE = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
LINEAR = 8
BLOCK = 256
#: Members that are compared with a pivot in one group; members of a bucket joined in one part.
GROUP, PART = 64, 4096
#: A key with more than 1 / HOT_KEYS of all rows is hot.
HOT_KEYS = 10000
#: Narrow rows (ids and digests) that are broadcast at most.
BROADCAST_ROWS = 200000
SEED = 7
#: Bytes of text worked on at once.
CHUNK_BYTES = 1 << 18

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts in turn, and the word count of each."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), dtype=np.uint8)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_BLANK[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Polynomial hash of data[start:end] from prefix sums modulo 2^64.
    n = len(data)
    power = np.empty(n + 1, dtype=np.uint64)
    power[0], power[1:] = 1, _ODD
    np.cumprod(power, out=power)
    inverse = np.empty(n + 1, dtype=np.uint64)
    inverse[0], inverse[1:] = 1, np.uint64(pow(int(_ODD), -1, 1 << 64))
    np.cumprod(inverse, out=inverse)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    words = _mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.diff(np.searchsorted(start, bounds))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        w = words[at:at + n]
        at += n
        k = min(size, n)
        if k == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(n - k + 1, k, dtype=np.uint64)  # the length tells a short sequence from a shingle
        for i in range(k):
            h = _mix(h * _ODD + w[i:n - k + 1 + i])
        out.append(np.unique(h))
    return out


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of ``BANDS * ROWS`` 32-bit numbers for each non-empty set."""
    a, b = _coefficients()
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(a)), dtype=np.uint32)
    for k in range(len(a)):
        h = values * a[k]
        h += b[k]
        h >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    v = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(v), BANDS))
    for i in range(ROWS):
        key = _mix(key * _ODD + v[:, :, i])
    return key.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2, CHUNK_BYTES):
            sets = shingle_sets([t or b"" for t in part.column(2).to_pylist()], shingle)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signature: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            full = np.flatnonzero(size)
            if len(full):
                s = signatures([sets[i] for i in full])
                for i, row, keys in zip(full.tolist(), s, band_keys(s).tolist()):
                    signature[i], sketch[i], bands[i] = row.tobytes(), row.astype(np.uint8).tobytes(), keys
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(size), pa.array(digest, pa.binary()),
                 pa.array(signature, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "text_key", "n", "set_key", "signature", "sketch", "bands"])
    return run


def least_matches(threshold: tuple[int, int] = THRESHOLD, miss: float = MISS) -> list[int]:
    """For each number of compared values, the fewest matches with a posterior of at least ``miss``."""
    t, out = threshold[0] / threshold[1], []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _prune(threshold: tuple[int, int]):
    """The pairs that stay likely by the low bytes of their signatures.  Low bytes
    match at least as often as the values, so no pair goes that these would keep."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(len(batch), BANDS * ROWS)
                           for i in (2, 3))
            alive, matches = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64)
            for k, fewest in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
                alive, matches = alive[matches >= fewest], matches[matches >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["a", "b"])
    return run


def _compare(shingle: int, threshold: tuple[int, int]):
    """Links (a, b) of one pivot b with the members a of one group: batches of
    signature values first, then both full sets."""
    least = least_matches(threshold)

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        found: list[int] = []
        if members.num_rows and pivots.num_rows:
            n, size = members["n"].to_numpy(), pivots["p_n"][0].as_py()
            left, right = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS)
                           for c in (members["signature"], pivots["p_signature"].slice(0, 1)))
            alive = np.flatnonzero(threshold[1] * np.minimum(n, size) >= threshold[0] * np.maximum(n, size))
            matches = np.zeros(len(alive), dtype=np.int64)
            for k, fewest in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (left[alive, part] == right[0, part]).sum(axis=1)
                alive, matches = alive[matches >= fewest], matches[matches >= fewest]
            if len(alive):
                own = shingle_sets([pivots["p_text"][0].as_py()], shingle)[0]
                rows = members.take(pa.array(alive))
                texts, ids = rows["text"].to_pylist(), rows["a"].to_pylist()
                for lo, hi in _chunks(texts):
                    for i, other in zip(ids[lo:hi], shingle_sets(texts[lo:hi], shingle)):
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if threshold[1] * both >= threshold[0] * (len(own) + len(other) - both):
                            found.append(i)
        pivot = pivots["pivot"][0].as_py() if pivots.num_rows else None
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([pivot] * len(found), pa.int64())})
    return run


def _known_size(saved: DataFrame) -> DataFrame:
    """A saved table of narrow rows, broadcast if it has at most ``BROADCAST_ROWS``
    (some 20 MB); beyond that Spark joins it as it finds best, by a shuffle at scale."""
    return F.broadcast(saved) if saved.count() <= BROADCAST_ROWS else saved


def _with_figures(rows: DataFrame, figures: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of figures of their key, of which ``size``
    is the key's number of rows.  Keys with more than 1 / ``HOT_KEYS`` of all rows
    are fewer than ``HOT_KEYS``; they are broadcast, so that no task meets all rows
    of such a key."""
    hot = F.col("size") * HOT_KEYS > total
    heavy = F.broadcast(figures.filter(hot))
    return rows.join(heavy, key).unionByName(
        rows.join(F.broadcast(figures.filter(hot).select(key)), key, "left_anti").join(figures.filter(~hot), key))


def _verify(pairs: DataFrame, sketches: DataFrame, full: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.  The signatures' low bytes
    leave the likely pairs; those of one b are dealt out in groups of about
    ``GROUP``, to each of which b's text goes once."""
    sized = (pairs.join(sketches.toDF("a", "n_a", "s_a"), "a").join(sketches.toDF("b", "n_b", "s_b"), "b")
             .filter(threshold[1] * F.least("n_a", "n_b") >= threshold[0] * F.greatest("n_a", "n_b")))
    pairs = save(sized.select("a", "b", "s_a", "s_b").mapInArrow(_prune(threshold), "a long, b long"))
    # Few pairs move no text but their own.
    figures = save(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size")).withColumn("groups", F.ceil(F.col("size") / GROUP)))
    dealt = save(_with_figures(pairs, figures, "b", pairs.count()).select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("part")))
    known = full.select("uid", "n", "signature", "text")
    members = _known_size(dealt).join(known.withColumnRenamed("uid", "a"), "a")
    pivots = (_known_size(figures).select(F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("of_part"))
              .join(known.toDF("pivot", "p_n", "p_signature", "p_text"), "pivot"))
    return (members.groupBy("b", "part").cogroup(pivots.groupBy("pivot", "of_part"))
            .applyInArrow(_compare(shingle, threshold), "a long, b long"))


def _block_links(shingle: int, threshold: tuple[int, int]):
    """Verified links between the two sides of one block (side 0: members outside
    the bucket's largest component, side 1: members)."""
    least = least_matches(threshold)

    def run(key, block):
        import pandas as pd

        def side(k):
            rows = block[block["side"] == k]
            texts = rows["text"].tolist()
            return (rows["uid"].to_numpy(), rows["c"].to_numpy(), rows["n"].to_numpy(), np.array(rows["bands"].tolist(), dtype=np.int64),
                    np.frombuffer(b"".join(rows["signature"]), dtype=np.uint32).reshape(len(rows), BANDS * ROWS), texts)

        own, other = side(0), side(1)
        if not len(own[0]) or not len(other[0]):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sets = shingle_sets(other[5], shingle)
        root = {c: c for c in {*own[1].tolist(), *other[1].tolist()}}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        found = []
        for i, mine in enumerate(shingle_sets(own[5], shingle)):
            shared = own[3][i] == other[3]
            rows = np.flatnonzero((own[1][i] != other[1]) & shared.any(axis=1)
                                  & (threshold[1] * np.minimum(own[2][i], other[2]) >= threshold[0] * np.maximum(own[2][i], other[2])))
            rows = rows[own[3][i][shared[rows].argmax(axis=1)] == key[0]]
            matches = np.zeros(len(rows), dtype=np.int64)
            for k, fewest in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (own[4][i, part] == other[4][rows, part]).sum(axis=1)
                rows, matches = rows[matches >= fewest], matches[matches >= fewest]
            for j in rows[np.argsort(-matches, kind="stable")].tolist():
                x, y = find(int(own[1][i])), find(int(other[1][j]))
                if x == y:
                    continue  # linked already
                both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                if threshold[1] * both >= threshold[0] * (len(mine) + len(sets[j]) - both):
                    root[max(x, y)] = min(x, y)
                    found.append((int(own[0][i]), int(other[0][j])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_component(rows: DataFrame, component: DataFrame) -> DataFrame:
    """``rows`` with the component ``c`` of ``uid``, itself if it has none."""
    return (rows.join(component.select(F.col("node").alias("uid"), "component"), "uid", "left")
            .withColumn("c", F.coalesce("component", "uid")).drop("component"))


def _priority(uid: str):
    return F.struct(F.xxhash64(uid).alias("h"), F.col(uid).alias("u"))


def _links(signed: DataFrame, docs: DataFrame, text_col: str, shingle: int, threshold: tuple[int, int]):
    """(classes, components): the classes of equal sets and (node, component) of the linked ones."""
    classes = save(signed.filter("n > 0").groupBy("set_key").agg(
        F.min("id").alias("id"), F.min("text_key").alias("text_key"), F.first("n").alias("n"),
        F.first("signature").alias("signature"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .withColumn("uid", F.monotonically_increasing_id()))
    total = BANDS * classes.count()
    exploded = classes.select("uid", F.explode("bands").alias("band"))
    buckets = save(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(_priority("uid"))["u"].alias("pivot"))
                   .filter("size > 1"))
    rows = save(_with_figures(exploded, buckets, "band", total))
    # Each class and the pivot of its largest bucket; a pivot comes before what it meets.
    near = save(rows.groupBy(F.col("uid").alias("a")).agg(F.max_by("pivot", F.struct("size", F.bitwise_not(F.xxhash64("pivot")), "pivot")).alias("b"),
                                                          F.count(F.lit(1)).alias("n_bands")))
    wanted = classes.join(near.select(F.col("a").alias("uid")), "uid", "left_semi")
    sketches = save(wanted.select("uid", "n", "sketch"))
    carried = docs.select(F.md5(F.col(text_col).cast("binary")).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    # Few wanted texts need no shuffle of all.
    texts = carried.join(_known_size(save(wanted.select("uid", "text_key"))), "text_key").groupBy("uid").agg(F.first("text").alias("text"))
    full = save(texts.join(wanted.select("uid", "n", "signature", "bands"), "uid"))
    near = near.filter("a <> b").select("a", "b")
    links = save(_verify(near, sketches, full, shingle, threshold))
    one_step = links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    # Buckets that still hold several components: each class and the pivot, if that is in
    # another one; of buckets with few such pairs, all of them.
    state = save(_with_component(rows.select("uid", "band"), one_step))
    k, size = F.col("k"), F.sum("k")
    buckets = save(state.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k"), F.min(_priority("uid")).alias("p"))
                   .groupBy("band").agg(size.alias("size"), ((size * size - F.sum(k * k)) / 2).alias("cross"),
                                        F.max(F.struct("k", "c"))["c"].alias("core"), F.min(F.struct("p", "c")).alias("best"))
                   .filter("cross > 0").select("band", "size", "core", F.col("best.p.u").alias("pivot"), F.col("best.c").alias("pivot_c"),
                                               (F.col("cross") <= LINEAR * F.col("size")).alias("few")))
    open_rows = save(_with_figures(state, buckets, "band", total))
    to_pivot = open_rows.filter("c <> pivot_c").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))
    # Members outside the largest component against all, a large bucket's members in parts.
    parts = F.ceil(F.col("size") / PART)
    few = open_rows.filter("few")
    outside = few.filter("c <> core").select("band", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
                                             F.col("uid").alias("a"), F.col("c").alias("a_c"))
    members = few.select("band", F.pmod(F.xxhash64("uid"), parts).alias("part"), F.col("uid").alias("b"), F.col("c").alias("b_c"))
    among = outside.join(members, ["band", "part"]).filter("a_c <> b_c").select("a", "b")
    pairs = save(_ordered(to_pivot.unionByName(among)).join(_ordered(near), ["a", "b"], "left_anti"))
    links = save(links.unionByName(_verify(pairs, sketches, full, shingle, threshold)))
    component = components(links, "a", "b")
    if buckets.filter("not few").isEmpty():
        return classes, component

    # The rest: blocks of those outside a bucket's largest component against all its members.
    cores = save(_with_component(buckets.filter("not few").select("band", F.col("core").alias("uid")), component).select(
        "band", F.col("c").alias("core")))
    placed = save(_with_component(open_rows.filter("not few").select("uid", "band"), component))
    count = (placed.join(cores, "band").groupBy("band", "core").agg(
        F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"),
        F.ceil(F.count_if(F.expr("c <> core")) / BLOCK).alias("own_blocks")).filter("own_blocks > 0"))
    sized = _with_figures(placed, save(count), "band", total)
    place = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    own_place = F.pmod(F.xxhash64("uid", F.lit(1)), F.col("own_blocks"))
    sides = sized.filter("c <> core").select("band", "uid", "c", F.lit(0).alias("side"), own_place.alias("x"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y")).unionByName(
        sized.select("band", "uid", "c", F.lit(1).alias("side"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_blocks") - 1)).alias("x"), place.alias("y")))
    found = save(sides.join(full, "uid").groupBy("band", "x", "y").applyInPandas(_block_links(shingle, threshold), "a long, b long"))
    if found.isEmpty():
        return classes, component
    # Only the roots that the blocks' links join are worked out anew.
    by_root = _with_component(_with_component(found.withColumnRenamed("a", "uid"), component).select(F.col("c").alias("a"), F.col("b").alias("uid")),
                              component).select("a", F.col("c").alias("b"))
    joined = save(components(by_root, "a", "b"))
    final = _with_component(component.select("node", F.col("component").alias("uid")), joined).select("node", F.col("c").alias("component"))
    return classes, final.unionByName(joined.join(component.select("node"), "node", "left_anti"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """(id, text_key, n, root, group_id) of each document; root and group_id are null for empty sets."""
    text = F.col(text_col).cast("binary")
    kind = dict(docs.dtypes)[id_col]
    signed = save(docs.select(F.col(id_col).alias("id"), F.md5(text).alias("text_key"), text.alias("text")).mapInArrow(
        _sign(shingle), f"id {kind}, text_key string, n long, set_key binary, signature binary, sketch binary, bands array<long>"))
    classes, component = _links(signed, docs, text_col, shingle, threshold)
    root = _with_component(classes.select("uid", "set_key", "id"), component).select("set_key", "id", F.col("c").alias("root"))
    least = save(root.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size")))
    groups = _with_figures(root, least, "root", classes.count()).select("set_key", "root", "group_id")
    # Documents are many, their classes' groups fewer; AQE splits a hot set.
    return signed.select("id", "text_key", "n", "set_key").join(groups, "set_key", "left").drop("set_key")


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept."""
    rows = _grouped(docs, id_col, text_col, shingle, threshold)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("id")).alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: one with the id that names it.  Rows
    are told apart by id and text, so an id that repeats with another text is
    judged by that text; of rows with the same id and text one stays, unless their
    text has no words or they have no id."""
    rows = _grouped(docs, id_col, text_col, shingle, threshold).filter("n > 0 AND id IS NOT NULL")
    alike = save(rows.groupBy("root", "id", "text_key").agg(F.count(F.lit(1)).alias("rows"), F.first("group_id").alias("group_id")))
    best = alike.filter("id = group_id").groupBy("root").agg(F.min("text_key").alias("best"))
    judged = alike.join(best, "root", "left")
    stays = (F.col("id") == F.col("group_id")) & (F.col("text_key") == F.col("best"))
    # Few rows to drop need no shuffle of all texts.
    gone = _known_size(save(judged.filter(~stays | (F.col("rows") > 1)).select(
        F.col("id").alias("__near_id"), F.col("text_key").alias("__near_text"), stays.alias("__near_one"))))
    same = (docs[id_col] == F.col("__near_id")) & (F.md5(docs[text_col].cast("binary")) == F.col("__near_text"))
    left = docs.join(gone, same, "left_anti")
    if gone.filter("__near_one").isEmpty():
        return left
    once = (docs.join(gone.filter("__near_one"), same).dropDuplicates(["__near_id", "__near_text"]))
    return left.unionByName(once.select(*[docs[c] for c in docs.columns]))


ORACLE = r"""
with recursive w as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as materialized (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
                          else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as sh from w)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as materialized (
  select a.doc_id as x, b.doc_id as y, count(*) as inter
  from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as materialized (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * inter >= 80 * (a.n + b.n - inter)),
both_ways as materialized (select x, y from e union select y, x from e),
reach(doc_id, root) as (
  select doc_id, doc_id from w
  union select b.y, r.root from reach r join both_ways b on b.x = r.doc_id)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.root) as component_id,
       min(r.root) = w.doc_id as kept
from w join reach r using (doc_id) left join n using (doc_id) group by w.doc_id
"""
