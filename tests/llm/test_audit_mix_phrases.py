"""Source divergence, source mixing and collocations against brute force; nulls,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import collocations, divergence, mixture
from parley.llm import quotient_filter as qf

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, item string, __place string, epoch int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0, 1, "x", "y", 2) for i, t, la, s in rows], COLUMNS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def planted():
    r = random.Random(11)
    words = ["Alpha", "beta", "gämma", "ÉTÉ", "delta", "x1y", "zeta's", "omega", "kilo", "lima"]
    docs = [(i, " ".join(r.choices(words, range(1, 11), k=r.randrange(0, 60))), r.choice(["en", "de", None]),
             r.choice(["s0", "s0", "s0", "s1", "ß", "", None])) for i in range(120)]
    docs += [(200, None, "en", "quiet"), (201, "", "en", "quiet"), (202, " \t12 34", "fr", "s0"), (203, "solo", "fr", "s1"),
             (204, "alpha beta " * 9000, "en", "s0"), (205, "tie one. tie two", "en", "s1"), (205, "tie one. tie two", "en", "s1"),
             (None, "beta beta", "en", "s1"), (None, None, None, None), (206, "ü" * 30000, "de", "ß")]
    return docs


def brute_audit(docs, top=200):
    terms = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, la, s in docs]
    out = []
    for lang in {la for la, _, _ in terms}:
        df, whole, own = Counter(), Counter(), defaultdict(Counter)
        for la, s, ts in terms:
            if la == lang:
                df.update(set(ts))
                whole.update(ts)
                own[s].update(ts)
        kept = sorted(t for t in df if df[t] >= 3)
        v, groups = len(kept), sorted(own)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}
        p, q = {s: shares(own[s]) for s in groups}, shares(whole)

        def ranked(s, part, rows):
            rows = sorted(rows, key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, s, part, i, f, k + 1) for k, (i, f) in enumerate(rows))
        for s in groups:
            ranked(s, "pair", [(b, sum((p[s][t] - p[b][t])**2 // p[b][t] for t in kept)) for b in groups if b != s])
            rows = [(t, (p[s][t] - q[t])**2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            ranked(s, "term", sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:top])
    return sorted(out)


def test_source_divergence(spark):
    got = sorted(tuple(r) for r in divergence.audit_sources(frame(spark, planted())).collect())
    assert got == brute_audit(planted())
    assert divergence.audit_sources(frame(spark, [])).count() == 0


def test_blocks_of_any_size_add_up(spark):
    kept, groups = divergence.count_terms(frame(spark, planted()))
    whole = sorted(map(tuple, divergence.pair_divergence(kept, groups).collect()))
    assert sorted(map(tuple, divergence.pair_divergence(kept, groups, block=2).collect())) == whole


def test_counters_are_passed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    got = sorted(tuple(r) for r in divergence.audit_sources(frame(spark, planted())).collect())
    assert got == brute_audit(planted())


def test_shares_and_runs():
    assert divergence.share(np.array([0, 10**11]), 10**12).tolist() == [1, 1 + 10**9 * (10**11 + 1) // 10**12]
    r = np.random.default_rng(5)
    length = r.integers(1, 9, 50)
    a, b = r.integers(1, 4, (2, 50)) * 1000
    got = divergence.diverge(divergence.run_lengths(a, length), divergence.run_lengths(b, length), int(length.sum()))
    assert got == (int(((a - b)**2 // b * length).sum()), int(((a - b)**2 // a * length).sum()))
    starts, values = divergence.run_lengths(np.array([4, 4, 7, 7, 4]), np.array([2, 1, 5, 1, 3]))
    assert starts.tolist() == [0, 3, 9] and values.tolist() == [4, 7, 4]


def words_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, limited = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in limited)
        w = sum(weight[s] for s in names if s not in limited)
        more = {s for s in names if s not in limited and most * sizes[s] * w <= weight[s] * rest}
        if not more:
            return {s: most * sizes[s] if s in limited else rest * weight[s] / w for s in names}
        limited |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    docs = planted()
    rows = mixture.taken_words(frame(spark, docs), seed=seed).collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), words_of(t)) for i, t, _, _ in docs)
    sized, targets, mix = mixture.mix_sources(frame(spark, docs), seed=seed)
    sizes = defaultdict(int)
    for _, t, _, s in docs:
        sizes[s] += words_of(t)
    want = brute_targets(sizes)
    assert {r.source: (r.source_size, r.target) for r in targets.collect()} == {s: (sizes[s], pytest.approx(want[s])) for s in sizes}
    taken, longest = defaultdict(int), defaultdict(int)
    source = {r.row: (r.source, r.size) for r in sized.collect()}
    for s, n in source.values():
        longest[s] = max(longest[s], n)
    order = sorted(mix.collect(), key=lambda r: r.mix_end)
    ends = 0
    for r in order:
        taken[source[r.row][0]] += r["size"]
        ends += r["size"]
        assert r.mix_end == ends and r["size"] == source[r.row][1]
    assert [r.finish for r in order] == sorted(r.finish for r in order) and ends <= sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    copies = Counter(r.row for r in order)
    assert max(copies.values()) <= 3 and len({(r.row, r.epoch) for r in order}) == len(order)
    assert all(r.taken <= 3 * r["size"] for r in rows) and sum(r.taken for r in rows) == ends


def test_mix_does_not_depend_on_the_partitions(spark):
    def run(df):
        return sorted(map(str, mixture.taken_words(df).collect()))
    assert run(frame(spark, planted())) == run(frame(spark, planted()[::-1]).repartition(7))


def test_mix_of_nothing(spark):
    assert mixture.taken_words(frame(spark, [])).count() == 0
    rows = mixture.taken_words(frame(spark, [(1, None, "en", None), (2, " ", "en", "s")])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5}, {"a": 7}, {None: 3, "a": 0, "b": 1, "c": 90, "d": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in mixture.source_targets(df).collect()} == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def brute_phrases(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, t, la, _ in docs:
        la = la or "und" if la is None else la
        n[la] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[la] += len(ws)
            for k in (1, 2, 3):
                f[la].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for la, c in f.items():
        cand, rows = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in cand.items():
            if len(p) == 2 and any(len(o) == 3 and p in (o[:2], o[1:]) and 100 * b >= 50 * a for o, b in cand.items()):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(la, i + 1, p.decode(), -a, x, y, n[la], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrases():
    r = random.Random(3)
    words = ["New", "york", "city", "of", "the", "naïve", "ÉCOLE", "ohm's", "a\x00b", "-", " x"]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;! "]) for _ in range(r.randrange(80))),
             r.choice(["en", "en", "de", None, "und"]), None) for i in range(90)]
    docs += [(1, None, "en", None), (2, "", None, None), (3, "new york city " * 300, "en", None), (3, "new york city " * 300, "en", None),
             (4, "w" * 70000 + " the", "de", None), (5, ".,;", "zz", None), (6, "lone", "yy", None), (7, "of " * 400, "de", None)]
    return docs


def test_collocations(spark):
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, phrases())).collect())
    assert got == brute_phrases(phrases()) and len(got) > 15
    assert collocations.mine(frame(spark, [])).count() == 0
    assert sorted(tuple(r) for r in collocations.mine(frame(spark, phrases()), top=5).collect()) == brute_phrases(phrases(), top=5)


@pytest.mark.parametrize("words, cut", [(7, 1 << 22), (50, 64), (1000, 16)])
def test_shard_borders_lose_nothing(spark, monkeypatch, words, cut):
    monkeypatch.setattr(collocations, "SHARD_WORDS", words)
    monkeypatch.setattr(collocations, "SLICE", cut)
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, phrases()).coalesce(2)).collect())
    assert got == brute_phrases(phrases())


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("vocabulary", [1, 200, 70000, 1 << 22, (1 << 25) - 1, 1 << 30, (1 << 32) - 1])
def test_packing_is_invertible(n, vocabulary):
    r = np.random.default_rng(n)
    for ranges in (1, 8, 64):
        to = qf.layout(n, vocabulary, ranges)
        ids = [r.integers(1, vocabulary + 1, 3000, dtype=np.uint64) for _ in range(n)]
        x, y = qf.split(ids, to)
        assert 0 <= to.remainder <= 64 and int(x.max()) < 1 << to.quotient
        assert all((a == b).all() for a, b in zip(ids, qf.join(x, y, to)))


def test_filters_merge_without_loss():
    r, to = np.random.default_rng(7), qf.layout(3, 900, 8)
    grams = [r.integers(1, 901, 4000, dtype=np.uint64) % np.uint64(30) + np.uint64(1) for _ in range(3)]
    want = Counter(zip(*(g.tolist() for g in grams)))
    shards = [qf.count(*qf.split([g[a::3] for g in grams], to)) for a in range(3)]
    parts = defaultdict(list)
    for s in shards:
        for k, f in qf.write_ranges(*s, 8, to):
            parts[k].append(f)
    got = {}
    for filters in parts.values():
        x, y, c = qf.merge(filters * 200, to)
        got.update(zip(zip(*(g.tolist() for g in qf.join(x, y, to))), c.tolist()))
    assert got == {k: 200 * v for k, v in want.items()}


def test_registered_queries_match_brute_force(spark):
    from parley.llm.common import table
    from parley.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op11_source_divergence"](spark, sf).collect())) == brute_audit(docs)
    assert sorted(map(tuple, QUERIES["op13_collocations"](spark, sf).collect())) == brute_phrases(docs)
