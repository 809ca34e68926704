"""Operator 13: collocations, phrases of two and three words that stand together
more often than their parts do by themselves.

1. The texts are split into pieces and words within the scan tasks.  A task
   cuts its rows into shards of ``SHARD_WORDS`` words and writes, for each shard
   and language, the words as numbers of the shard's own dictionary, and that
   dictionary with its counts.
2. The dictionaries are summed up by word.  Words of at least ``LEAST`` occurrences
   get dense ids over all languages; no phrase with another word can be a
   candidate.  The ids go back to the shards' dictionaries by a join, so no
   task ever holds more than the words of one shard.
3. Each shard counts its bigrams and trigrams in counting quotient filters
   (``quotient_filter``), split by ranges of quotients.  The filters of a range are
   merged across shards in one task; the permutation makes ranges equally
   large whatever the words, and their number grows with the corpus.
4. The counts of at least ``LEAST`` are read back into ids, and candidates are joined
   with the counts of their parts, which are counts of that size as well.

Counts and scores are exact (decimals where 64 bits do not suffice).  Nothing
is broadcast by hint and only two totals reach the driver.

Defined results: null texts are empty, a null language is ``und`` (as is that
name); an empty table or one without candidates gives no rows; repeated rows
count as often as they stand; a very long text is cut into several shards, whose
borders lose no phrase.  Other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import empty_if_null, first_of_group, position_after_sort, save

LEAST = 10
TOP = 2000
#: A candidate goes if a longer one holds it and has this share of its occurrences.
HELD_BY = 50
SHARD_WORDS = 2000000
#: Entries (at most) that the filters of one range hold together.
RANGE_ENTRIES = 4000000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 22

# A word, or a run of the characters that end a piece.
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]+")
ENDS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
SHARDS = "shard long, lang string, context int, ids binary, word binary, local int, n long"


class _Words(dict):
    """Numbers of the words met, from 1; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = 0 if word[0] in ENDS else len(self) + 1
        return number


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes, cut after a blank, tab or line end."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(c, at, at + SLICE) for c in (b" ", b"\t", b"\n"))
        if cut < at:  # no blank for that long: the next one of any kind
            found = [c for c in (text.find(b, at + SLICE) for b in (b" ", b"\t", b"\n")) if c >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut + 1]
        at = cut + 1
    yield text[at:]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1.  Two kinds of rows: (shard, lang, context, ids), whose first ``context``
    ids belong to the shard before it, and (shard, lang, word, local, n)."""
    task, number = TaskContext.get().partitionId(), 0
    held: dict[str, tuple[_Words, array]] = {}
    words = 0

    def batch(**columns):
        kinds = dict(shard=pa.int64(), lang=pa.string(), context=pa.int32(), ids=pa.binary(), word=pa.binary(),
                     local=pa.int32(), n=pa.int64())
        size = len(columns["shard"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), k) for c, k in kinds.items()], names=list(kinds))

    def out(open_lang: str | None = None):
        """Everything held, as one shard; ``open_lang`` goes on within a piece."""
        nonlocal number, words
        shard, after = (task << 32) + number, {}
        for lang, (known, ids, context) in held.items():
            if len(ids) <= context:
                continue
            numbers = np.frombuffer(ids, np.uint32)
            yield batch(shard=[shard], lang=[lang], context=[context], ids=[numbers.tobytes()])
            # Runs of ends take up numbers, so there are gaps.  Words of the context
            # need their ids here as well, but count in the shard before.
            n = np.bincount(numbers[context:], minlength=len(known) + 1)
            own = [(w, k) for w, k in known.items() if k]
            for a in range(0, len(own), 1 << 16):
                part = own[a:a + (1 << 16)]
                yield batch(shard=[shard] * len(part), lang=[lang] * len(part), word=[w for w, _ in part],
                            local=[k for _, k in part], n=[int(n[k]) for _, k in part])
            if lang == open_lang:
                spelt = {k: w for w, k in known.items() if k}
                after[lang] = [spelt.get(k) for k in ids[-2:]]
        held.clear()
        words, number = 0, number + 1
        for lang, last in after.items():
            known = _Words()
            held[lang] = (known, array("I", [known[w] if w else 0 for w in last]), len(last))

    for rows in batches:
        for lang, text in zip(*(c.to_pylist() for c in rows.columns)):
            for part in _slices(text.encode().lower()):  # of bytes: A-Z only
                known, ids, _ = held.setdefault(lang, (_Words(), array("I"), 0))
                before = len(ids)
                ids.extend(map(known.__getitem__, TOKEN.findall(part)))
                words += len(ids) - before
                if words >= SHARD_WORDS:
                    yield from out(lang)
            if lang in held:
                held[lang][1].append(0)
        if words >= SHARD_WORDS:
            yield from out()
    yield from out()


def encode(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(texts, dictionaries) of all shards."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), empty_if_null(text_col).alias("text"))
    both = save(rows.mapInArrow(_encode, SHARDS))
    return (both.filter("ids IS NOT NULL").select("shard", "lang", "context", "ids"),
            both.filter("word IS NOT NULL").select("shard", "lang", "word", "local", "n"))


def number_words(dictionaries: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(words, totals): (lang, word, f, id) of each word with ``least`` occurrences, and (lang, n)."""
    counted = save(dictionaries.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    words = position_after_sort(counted.filter(F.col("f") >= least), ["lang", "word"], "id")
    return save(words.withColumn("id", F.col("id") + 1)), counted.groupBy("lang").agg(F.sum("f").alias("n"))


def _count_shard(ranges: int, layouts: list[qf.Layout]):
    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        langs = {}
        for lang in set(names["of_lang"].to_pylist()):
            mine = names.filter(pa.compute.equal(names["of_lang"], lang))
            langs[lang] = mine["local"].to_numpy(), mine["id"].to_numpy()
        parts: dict[int, list] = {to.n: [] for to in layouts}
        for lang, context, data in zip(texts["lang"].to_pylist(), texts["context"].to_pylist(), texts["ids"]):
            if lang not in langs:
                continue
            local = np.frombuffer(data.as_buffer(), np.uint32)
            known = np.zeros(int(max(local.max(initial=0), langs[lang][0].max(initial=0))) + 1, np.uint32)
            known[langs[lang][0]] = langs[lang][1]
            ids = known[local]
            for to in layouts:
                # An n-gram counts where it ends, unless that is before this shard.
                first = max(0, context - to.n + 1)
                places = [ids[first + k:len(ids) - to.n + 1 + k] for k in range(to.n)]
                whole = np.logical_and.reduce([p > 0 for p in places])
                parts[to.n].append(qf.split([p[whole] for p in places], to))
        for to in layouts:
            if parts[to.n]:
                x, y, counts = qf.count(*(np.concatenate(c) for c in zip(*parts[to.n])))
                out += [(to.n, r, f) for r, f in qf.write_ranges(x, y, counts, ranges, to)]
        return pa.table({"n": pa.array([o[0] for o in out], pa.int32()), "part": pa.array([o[1] for o in out], pa.int32()),
                         "filter": pa.array([o[2] for o in out], pa.binary())})
    return run


def _merge(layouts: list[qf.Layout], least: int):
    by_n = {to.n: to for to in layouts}

    def run(table: pa.Table) -> pa.Table:
        to = by_n[table["n"][0].as_py()]
        x, y, counts = qf.merge(table["filter"].to_pylist(), to)
        often = counts >= least
        ids = qf.join(x[often], y[often], to)
        ids += [np.zeros(int(often.sum()), np.int64)] * (3 - to.n)
        return pa.table({"n": pa.array(np.full(int(often.sum()), to.n), pa.int32()),
                         **{c: pa.array(i.astype(np.int64)) for c, i in zip("abc", ids)}, "f": pa.array(counts[often])})
    return run


def count_phrases(texts: DataFrame, dictionaries: DataFrame, words: DataFrame, least: int = LEAST,
                  range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """(n, a, b, c, f): all phrases of two words (c = 0) and three with ``least`` occurrences."""
    vocabulary = words.count()
    total = dictionaries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = 1 << max(0, int(-(-total // range_entries) - 1).bit_length())
    ranges = min(max(ranges, 8), 1 << 16)
    layouts = [qf.layout(n, vocabulary, ranges) for n in (2, 3)]
    known = dictionaries.join(words, ["lang", "word"]).select(
        F.col("shard").alias("of_shard"), F.col("lang").alias("of_lang"), "local", "id")
    filters = (texts.groupBy("shard").cogroup(known.groupBy("of_shard"))
               .applyInArrow(_count_shard(ranges, layouts), "n int, part int, filter binary"))
    return save(filters.groupBy("n", "part").applyInArrow(_merge(layouts, least), "n int, a long, b long, c long, f long"))


def _score(a: str, left: str, right: str):
    big = "CAST({} AS DECIMAL(38,0))"
    return F.expr(f"({big.format(1000000)} * {big.format(a)} * {a}) div ({big.format(left)} * {right})")


def candidates(phrases: DataFrame, words: DataFrame, held_by: int = HELD_BY) -> DataFrame:
    """(a_id, b_id, c_id, lang, phrase, a, l, r, score) of all candidates that no longer one holds."""
    two, three = phrases.filter("n = 2").select("a", "b", "f"), phrases.filter("n = 3").select("a", "b", "c", "f")
    of = {p: words.select(F.col("id").alias(p), F.col("f").alias(f"f_{p}"), F.col("word").cast("string").alias(f"w_{p}"),
                          F.col("lang").alias(f"lang_{p}")) for p in "abc"}
    longer = (three.select("a", "b", "f").unionByName(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
              .groupBy("a", "b").agg(F.max("f").alias("longest")))
    pairs = (two.join(longer, ["a", "b"], "left")
             .filter(F.coalesce(100 * F.col("longest") < held_by * F.col("f"), F.lit(True)))
             .join(of["a"], "a").join(of["b"], "b")
             .select(F.col("lang_a").alias("lang"), F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.col("f").alias("a"),
                     F.col("f_a").alias("l"), F.col("f_b").alias("r"), _score("f", "f_a", "f_b").alias("score")))
    triples = (three.join(two.withColumnRenamed("f", "f_ab"), ["a", "b"])
               .join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")), ["b", "c"])
               .join(of["a"], "a").join(of["b"], "b").join(of["c"], "c")
               .withColumn("s1", _score("f", "f_a", "f_bc")).withColumn("s2", _score("f", "f_ab", "f_c")))
    early = F.col("s1") <= F.col("s2")
    return pairs.unionByName(triples.select(
        F.col("lang_a").alias("lang"), F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("f").alias("a"),
        F.when(early, F.col("f_a")).otherwise(F.col("f_ab")).alias("l"),
        F.when(early, F.col("f_bc")).otherwise(F.col("f_c")).alias("r"), F.least("s1", "s2").alias("score")))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
         held_by: int = HELD_BY) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score."""
    texts, dictionaries = encode(docs, text_col, lang_col)
    words, totals = number_words(dictionaries, least)
    found = candidates(count_phrases(texts, dictionaries, words, least), words, held_by)
    ranked = first_of_group(found, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top, "rank", "phrase")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS phrase
  FROM lists, (VALUES (1), (2), (3)) t(n)),
f AS (SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
cand AS (SELECT lang, n AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1),
parts AS (SELECT lang, phrase, a, k, size - k AS n_right, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM cand CROSS JOIN (VALUES (1), (2)) t(k) WHERE k < size),
cuts AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.n = k AND l.phrase = first
  JOIN f r ON r.lang = c.lang AND r.n = n_right AND r.phrase = rest),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, max(longer) AS longer FROM (SELECT lang, a AS longer,
    unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (SELECT x.* FROM least x LEFT JOIN held h ON h.lang = x.lang AND h.phrase = x.phrase WHERE coalesce(100 * h.longer < 50 * x.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
