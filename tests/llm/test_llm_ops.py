"""The operators on small planted tables against brute force; nulls, empty and
long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import (chat_format, common, components, decontaminate, exact_dedup, near_dedup, packing, quality, secrets,
                        sharding, substring_dedup, url_filter)

WORDS = [a + b for a in "ba ke li mo nu sa te vi zo re".split() for b in "ran tel dis mon gar pil sor".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def planted():
    base, shared = prose(1, 200), prose(2, 60)
    near = base.split()
    near[50] = "changed"
    docs = [(1, base), (2, base), (3, "  " + base.replace(" ", "\n")), (4, " ".join(near)), (5, prose(3, 120)),
            (6, prose(4, 80) + " " + shared + " " + prose(5, 70)), (7, prose(6, 30) + " " + shared), (8, None), (9, ""),
            (10, " \t\n"), (11, "one"), (12, "ONE"), (13, prose(7, 30000)), (14, "x" * 50000), (15, "ünï çödé " * 40),
            (16, prose(8, 10) + " " + "benchmark item words that stand together in the very same order here"),
            (17, "a b c"), (17, "a b c"), (None, "no id " + prose(9, 40)), (None, None)]
    return docs


DOCS = "doc_id long, text string, lang string, source string, n_chars long, __id string, `id` string, `n` string"


def frame(spark, rows):
    full = [(i, t, "en", "s" if k % 3 else None, len(t or ""), "x", "y", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, planted())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_exact_dedup(docs, none):
    rows = exact_dedup.find_duplicates(docs).collect()
    assert len(rows) == len(planted())
    groups = defaultdict(list)
    for i, t in planted():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    want = sorted(((i, min(g)[3], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == want
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert exact_dedup.find_duplicates(none).count() == 0 == exact_dedup.drop_duplicates(none).count()


def test_exact_dedup_heavy_groups_leave_before_the_shuffle(spark):
    rows = [(i, "hot text" if i % 3 else f"own {i}") for i in range(900)]
    df = frame(spark, rows)
    narrow = exact_dedup._narrow(df, "doc_id", "text")
    heavy = exact_dedup.heavy_winners(narrow, "doc_id", 0.01).collect()
    assert [(h["__dedup_heavy"], h["__dedup_keep"]) for h in heavy] == [(600, 1)]
    found = exact_dedup.find_duplicates(df, support=0.01).collect()
    assert len(found) == 900 and sum(r.kept for r in found) == 301
    assert {r.group_size for r in found} == {600, 1}
    assert exact_dedup.drop_duplicates(df, support=0.01).count() == 301


def brute_near(docs, size):
    sets = []
    for i, t in docs:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", ws) if w]
        k = min(size, len(ws))
        sets.append({tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)} if k else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        f = find(k)
        if i is not None:
            least[f] = min(least.get(f, i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(docs, none, size):
    rows = near_dedup.find_near_duplicates(docs, shingle=size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute_near(planted(), size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert near_dedup.find_near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize("linear", [near_dedup.LINEAR, 0])
def test_near_dedup_hub_and_chain(spark, monkeypatch, linear):
    """A hub whose variants are not linked to each other, and a chain of small steps;
    with ``linear`` 0 every bucket that is left over goes through the blocks."""
    monkeypatch.setattr(near_dedup, "LINEAR", linear)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r, rows = random.Random(5), []
    base = prose(20, 220).split()
    rows.append((500, " ".join(base)))
    for i in range(60):
        own = list(base)
        for j in r.sample(range(220), 9 if i % 3 else 13):  # every third is too far from the hub
            own[j] = f"w{i}x{j}" if i % 5 else f"same{j}"
        rows.append((100 + i, " ".join(own)))
    step = prose(21, 200).split()
    for i in range(25):
        rows.append((i, " ".join(step)))
        step = step[4:] + [f"n{i}a{k}" for k in range(4)]
    got = near_dedup.find_near_duplicates(frame(spark, rows), shingle=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_near(rows, 2))


def test_signatures_estimate_similarity():
    a, b = prose(30, 3000).split(), prose(30, 3000).split()
    b[::40] = [f"q{i}" for i in range(len(b[::40]))]
    s = near_dedup.shingle_sets([" ".join(a).encode(), " ".join(b).encode()], 2)
    both = len(np.intersect1d(*s))
    similarity = both / (len(s[0]) + len(s[1]) - both)
    sig = near_dedup.signatures(s)
    assert abs((sig[0] == sig[1]).mean() - similarity) < 0.12


def test_least_matches_keep_the_posterior():
    least = near_dedup.least_matches()
    assert least == sorted(least) and len(least) == 5
    assert least[-1] < 0.8 * 160 and least[0] >= 0


BENCH = [(1, "Benchmark item words that stand together in the very same order here"), (2, "a b"), (3, None), (4, ""),
         (5, prose(6, 30)[:80]), (6, "Benchmark item words that stand together in the very same order here"), (None, "x y z w")]


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(i, t, "z") for i, t in BENCH], "item_id long, text string, doc_id string")
    want = sorted((x[:4] for x in decontaminate.brute_force(planted(), BENCH[:-1])), key=str)
    for block in (100_000, 10):
        rows = decontaminate.find_hits(docs, bench.filter("item_id is not null"), block_words=block).collect()
        got = sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"])) for r in rows), key=str)
        assert got == want
    assert decontaminate.find_hits(none, bench).count() == 0
    assert all(r.spans == [] for r in decontaminate.find_hits(docs, bench.limit(0)).collect())
    clean = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    assert 16 not in clean and clean[5] == dict(planted())[5]
    again = decontaminate.find_hits(decontaminate.clean(docs, bench), bench).collect()
    assert sum(len(r.spans) for r in again) == 0


def test_suffix_automaton_equals_brute_force_on_random_words():
    r = random.Random(3)
    for trial in range(60):
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(5)]
        docs = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for i in range(6)]
        window = r.choice([2, 3, 5, 10])
        auto = decontaminate.SuffixAutomaton([(i, t.encode().split()) for i, t in items], window)
        got = [(i, n, sum(b - a for a, b in s), len(x)) for (i, _), (n, s, x) in
               zip(docs, decontaminate.scan([t.encode() for _, t in docs], auto))]
        assert got == [x[:4] for x in decontaminate.brute_force(docs, items, window)]


def test_url_filter(spark):
    pages = [(1, "http://a.example.net/en/1", None), (2, "https://a.EXAMPLE.net/de/1", ""), (3, "http://x.org/fr/a?b", None),
             (4, "http://plain.com/a.html", '<link rel="canonical" href="http://bad.net/x">'), (5, "http://bad.net/x", None),
             (6, None, None), (7, "no scheme", None), (8, "https://plain.com/a#top", ""), (9, "http://net", None),
             (10, "http://free.com/q", "<link href='http://example.net/en/z' rel=canonical>"),
             (11, "http://free.com/q/", '<meta http-equiv="refresh" content="0; url=http://bad2.net/x">'),
             (12, "http://example.net/en/z", None), (5, "http://bad.net/x", None), (13, "http://planet/x", None)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, component string")
    rows = url_filter.judge_urls(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de/1", "net/", "block")
    assert got[3] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[4] == ("plain.com", "/a.html", None, "block") and got[8][3] == "block"
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[9] == ("net", "", None, "allow") and got[13][2] is None
    assert got[10][3] == "allow" and got[11][3] == "allow"  # an allowed member of the class takes precedence
    moved = spark.createDataFrame([("http://planet/x", "http://bad.net/x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df, redirects=moved).collect()}[13] == "block"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(330)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(g.node, g.component) for g in got} == {(x, find(x)) for x in root} and len(got) == len(root)


def test_sharding(spark, docs, none):
    rows = [(i, f"text {i}") for i in range(2000)]
    full = [(i, t, "en", "hot" if i % 3 else f"s{i % 7}", 0, "", "", "") for i, t in rows]
    got = sharding.assign_shards(spark.createDataFrame(full, DOCS), shards=24).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    source = {i: s for i, _, _, s, *_ in full}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.size == len(f"text {r.doc_id}") + 8 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
    assert set(map(len, by.values())) <= {83, 84} and len(by) == 24
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for s in set(source.values()):
            share = sum(v == s for v in source.values()) / 24
            assert abs(sum(source[r.doc_id] == s for r in own) - share) < 2
    few = sharding.assign_shards(docs).collect()
    assert len(few) == len(planted()) and all(r.slot == 0 for r in few)
    assert sharding.assign_shards(none).count() == 0


def test_write_shards(spark, scratch):
    df = frame(spark, [(i, prose(i, 5)) for i in range(100)])
    sharding.write_shards(df, scratch + "/out", shards=4)
    back = spark.read.parquet(scratch + "/out")
    assert back.count() == 100 and {r["count"] for r in back.groupBy("shard").count().collect()} == {25}


SECRETS = [(1, 'x "api_key" : "abcdEFGH12" AKIAABCDEFGHIJKL ' + "0123456789abcdef" * 2), (2, "secret: token: abcdefghijk"),
           (3, None), (4, 'x "api_key" : "abcdEFGH12" AKIAABCDEFGHIJKL ' + "0123456789abcdef" * 2), (5, "paſsword=abcdefgh1"),
           (6, "ü PASSWORD=abcdefgh1"), (7, "-----BEGIN RSA PRIVATE KEY-----"), (8, "AKIASHORT " + "f" * 31), (4, None)]


def test_secrets(spark, scratch, none):
    df = frame(spark, SECRETS)
    ledger = scratch + "/ledger"
    got = defaultdict(list)
    for r in secrets.find_secrets(df, ledger).collect():
        got[r.doc_id].append([(s.kind, s.start, s.end) for s in r.spans])
    assert got[1] == [[("assign", 3, 25), ("access", 27, 43), ("hex", 44, 76)]]
    assert got[2] == got[3] == got[5] == got[8] == [[]]  # the first match takes "token", which is too short
    assert sorted(got[4]) == [[], got[1][0]] and got[6] == [[("assign", 2, 20)]] and got[7] == [[("pem", 0, 31)]]
    assert secrets.find_secrets(none).count() == 0
    blobs = secrets.read_ledger(spark, ledger)
    assert blobs.count() == len({t or "" for _, t in SECRETS})
    more = frame(spark, [*SECRETS, (20, "token = zzzzzzzzz")])
    secrets.scan_unseen(more, ledger)
    assert secrets.read_ledger(spark, ledger).count() == len({t or "" for _, t in SECRETS}) + 1  # one new blob was scanned
    secrets.scan_unseen(more, ledger, rule_version="next")
    assert secrets.read_ledger(spark, ledger, "next").count() == len({t or "" for _, t in SECRETS}) + 1


def test_packing(docs, none):
    rows = packing.pack(docs, with_ids=True).collect()
    encode = packing.encoder(packing.default_vocabulary())
    by, whole, count = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id not in (17, None):
            whole[r.doc_id].append(r)
        count[r.doc_id] += r.piece == 0
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, t in planted():
        assert count[i] == sum(j == i for j, _ in planted())
        if i in whole:
            parts = sorted(whole[i], key=lambda r: r.piece)
            assert sum((p.ids for p in parts), []) == encode(t or "") + [2]
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert all(p.length == 1024 for p in parts[1:])
    total = sum(r.length for r in rows)
    assert sum(len(r.ids) for r in packing.sequences(packing.pack(docs, with_ids=True)).collect()) == total
    assert packing.pack(none).count() == 0


def test_best_fit_choices():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.place(9) == (2, 0) and bins.place(8) == (3, 0) and bins.place(7) == (4, 0)  # the fullest (2) has closed
    assert bins.place(1) == (3, 8)
    r = random.Random(0)
    sizes = [r.randint(1, 1024) for _ in range(20000)]
    bins = packing.BestFit()
    for n in sizes:
        bins.place(n)
    assert bins.made <= 1.02 * sum(sizes) / 1024 and bins.open <= packing.OPEN_SEQUENCES


def test_both_libraries_give_the_same_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.encoder(packing.default_vocabulary())
    texts = [t or "" for _, t in planted()] + ["<|endoftext|>x", "a <|endoftext|><|endoftext|> <|endoftext |>", "<|endoftext|> it's  \n\n x\u0085y　z ² \U0001f600"]
    texts += [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}" for c in range(0, 0x3000, 7)]
    assert [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)] == [fast(t) for t in texts]


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "a\\s<b"), (1, 1, "user", "</turn>\n<turn>x\n"), (1, 2, "assistant", "\\l\\s\\n<"), (1, 2, "assistant", ""),
            (2, 0, None, None), (None, 0, "user", "null id"), (3, 5, "ro\nle<", "\n\n"), (3, None, "assistant", "first"),
            (4, 0, "assistant", "x" * 100000), (4, 0, "assistant", "x" * 100000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    made = chat_format.format_branches(chat_format.messages_by_turn(df))
    got = made.select("tree", chat_format.read_back().alias("turns"), chat_format.read_loss().alias("loss")).collect()
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert {g.tree: [(t.role, t.text) for t in g.turns] for g in got} == by
    assert {g.tree: g.loss for g in got} == {c: "".join(t for r, t in v if r == "assistant") for c, v in by.items()}
    assert chat_format.format_branches(chat_format.messages_by_turn(df.limit(0))).count() == 0


def test_reply_trees(spark):
    #        1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; 7 <-> 8 is a cycle with leaf 9
    links = [(1, None, 0.0), (2, 1, 5.0), (4, 2, 1.0), (3, 1, 1.0), (5, 3, 1.0), (6, 5, 1.0), (7, 8, 0.0), (8, 7, 0.0), (9, 8, 0.0)]
    df = spark.createDataFrame([(0, n, p, "assistant" if n % 2 else "user", f"m{n}", s) for n, p, s in links],
                               "tree long, node long, parent long, role string, text string, score double")
    rows = chat_format.format_branches(df).select("leaf", "rank", chat_format.read_back().alias("t")).collect()
    assert {(r.leaf, r["rank"], " ".join(t.text for t in r.t)) for r in rows} == {(4, 1, "m1 m2 m4"), (6, 2, "m1 m3 m5 m6")}
    best = chat_format.format_branches(df, top=1).collect()
    assert [(r.leaf, r["rank"]) for r in best] == [(4, 1)]


def test_deep_reply_chain(spark):
    from pyspark.sql import functions as F
    df = spark.range(1500).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                  F.col("id").cast("string").alias("text"))
    row = chat_format.format_branches(chat_format.messages_by_turn(df)).select(chat_format.read_back().alias("t")).collect()
    assert len(row) == 1 and [t.text for t in row[0].t] == [str(i) for i in range(1500)]


def test_substring_dedup(docs, none):
    rows = substring_dedup.find_repeats(docs).collect()
    text = {i: t for i, t in planted()}
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.end))
        assert r.n_words >= 25 and r.doc_id not in r.first_ids
        assert any(text[r.doc_id][r.start:r.end][:60] in (text[f] or "") for f in r.first_ids)
    assert {2, 4, 7} <= set(spans) and not {1, 5, 6, 13, 14, 16} & set(spans)
    cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs.filter("doc_id < 17")).collect()}
    for i in range(1, 17):
        assert len(cut[i] or "") == len(text[i] or "") - sum(b - a for a, b in spans[i])
    assert cut[8] is None and substring_dedup.find_repeats(none).count() == 0


def test_repeated_pieces_of_many_documents_are_no_passage(spark):
    """Every word stands in an earlier document, 20 in a row at most."""
    words = prose(41, 400).split()
    rows = [(k, prose(1000 + k, 30) + " " + " ".join(words[8 * k:8 * k + 20]) + " " + prose(2000 + k, 30)) for k in range(48)]
    rows.append((900, " ".join(words)))
    assert substring_dedup.find_repeats(frame(spark, rows)).count() == 0
    held = rows[:48] + [(800, prose(42, 30) + " " + " ".join(words[100:160]) + " " + prose(43, 30)), rows[-1]]
    (r,) = substring_dedup.find_repeats(frame(spark, held)).filter("doc_id = 900").collect()
    assert r.first_ids == [800] and rows[-1][1][r.start:r.end] in held[48][1] and r.n_words >= 25


def repeated_words(a, b):
    """Words of ``b`` inside windows that ``a`` holds as well."""
    (da, _, wa), (db, _, wb) = substring_dedup.chunks([a.encode(), b.encode()])
    held = set(substring_dedup.window_digests(da, *substring_dedup.windows(wa, 25)).tolist())
    first, end = substring_dedup.windows(wb, 25)
    marks = np.zeros(len(wb), dtype=bool)
    for x, y, d in zip(first, end, substring_dedup.window_digests(db, first, end).tolist()):
        marks[x:y] |= d in held
    return int(wb[marks].sum())


@pytest.mark.parametrize("longest", [1, 2, 4, 7, 12])
def test_every_shared_passage_of_50_words_is_found(longest):
    r = random.Random(longest)

    def some(n):
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, longest))) for _ in range(n))
    for _ in range(600):
        shared = some(r.choice((50, 51)))
        a, b = (some(r.randrange(40)) + r.choice("é\n ") + shared + r.choice(" é\n") + some(r.randrange(40)) for _ in "ab")
        assert 25 <= repeated_words(a, b)


@pytest.mark.parametrize("unit", ["ha ", "buy now ", "7 ", "0\t1\t", "x  ", "a bb ", "not so very long ", "über ", "one two three four five six seven "])
def test_passages_of_a_short_period_are_found(unit):
    for extra in range(12):
        shared = (unit * 200)[:50 * 12 + extra] if len(unit) > 8 else unit * (60 + extra)
        a, b = prose(3000 + extra, 40) + " " + shared + prose(3100 + extra, 40), prose(3200 + extra, 33) + " " + shared + prose(3300, 20)
        n = len(shared.split())
        assert n >= 50 and n - 25 <= repeated_words(a, b) <= n
    assert repeated_words(prose(3400, 200), b) == 0


def test_a_line_said_over_and_over_is_counted_once(spark, monkeypatch):
    line = "the very same line again and again "
    a, b = prose(3500, 40) + " " + line * 30 + prose(3501, 40), prose(3502, 33) + " " + line * 300 + prose(3503, 20)
    kept = []
    monkeypatch.setattr(substring_dedup, "save", lambda df, f=common.save: kept.append(f(df)) or kept[-1])
    (r,) = substring_dedup.find_repeats(frame(spark, [(1, a), (2, b)])).collect()
    assert (r.doc_id, r.first_ids) == (2, [1]) and 2100 - 25 <= r.n_words <= 2100 and line * 290 in b[r.start:r.end]
    for row in kept[0].collect():
        found = [d for d in row.digests if d is not None]
        assert len(found) == len(set(found)) and len(found) + len(row.again) // 2 == len(row.digests)


def test_windows_cover_every_long_run():
    r = random.Random(6)
    for _ in range(50):
        words = np.array([r.randrange(0, 9) for _ in range(r.randrange(0, 40))], dtype=np.int64)
        got = list(zip(*(x.tolist() for x in substring_dedup.windows(words, 25))))
        assert all(words[a:b].sum() >= 25 for a, b in got)
        for a, b in itertools.combinations(range(len(words) + 1), 2):
            if words[a:b].sum() >= 25:
                assert {k for x, y in got if a <= x and y <= b for k in range(x, y)} == set(range(a, b))


def test_chunks_resist_insertions():
    t = prose(40, 2000)
    a = set(substring_dedup.chunks([t.encode()])[0][0].tolist())
    b = set(substring_dedup.chunks([("inserted words " + t[:5000] + " more " + t[5000:]).encode()])[0][0].tolist())
    assert len(a - b) <= 4
    digests, ends, words = substring_dedup.chunks(["ünï çödé".encode(), b"", "ab".encode()])[0]
    assert ends[-1] == 8 and words.sum() == 2


def brute_marginals(score, transition):
    n, good, z = len(score), np.zeros(len(score)), 0.0
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(s for s, y in zip(score, labels) if y) + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
        z += w
        good += w * np.array(labels)
    return good / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 6, 2])
    score, transition = rng.normal(size=12), rng.normal(size=(2, 2))
    got = quality.marginals(score, transition, counts)
    at = 0
    for n in counts:
        assert np.allclose(got[at:at + n], brute_marginals(score[at:at + n], transition))
        at += n


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    model = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(quality.held_out()).collect()
    assert len(rows) > 50
    assert np.mean([(r.score >= quality.GOOD) == bool(r.quality) for r in rows]) > 0.97
    alone = model.quality([(r.text or "").encode() for r in rows])
    assert np.allclose(alone, [r.score for r in rows])


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 1, "x"), (5, 0, "x"), (14, 0, "x"), (6, None, "x")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    values = [r.score for r in scored.collect()]
    assert len(values) == len(planted()) and all(0 <= v <= 1 for v in values)
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())
    assert quality.score(none, model).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_labels_beyond_the_documents(spark):
    junk = [(100 + i, "!!! $$ ## || " * 20) for i in range(40)]
    part = frame(spark, [(i, prose(i, 60)) for i in range(40)] + junk)
    kind = "doc_id long, quality int"
    own = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i, _ in junk], kind)
    wide = own.unionByName(spark.createDataFrame([(i, i % 2) for i in range(1000, 5000)], kind))
    a, b = (quality.train(part, x, train_docs=30) for x in (own, wide))
    assert a.fitted and np.array_equal(a.weights, b.weights)
    for x in (own.limit(0), spark.createDataFrame([(1, None)], kind), wide.filter("doc_id >= 1000")):
        assert quality.keep_good(part, x).count() == 80
