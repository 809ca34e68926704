"""Registered queries without whole SQL oracles against brute force on the
smallest data set, and repeated ids, links, late labels and grown ledgers."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import decontaminate, exact_dedup, near_dedup, packing, quality, secrets, sharding, substring_dedup, url_filter
from parley.llm.common import table
from parley.llm.queries import QUERIES
from test_llm_ops import frame, planted, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def test_sharding_is_the_order_of_fractional_ranks(spark):
    rows = [(r.doc_id, r.text or "", r.source) for r in table(spark, SF, "documents").collect()]
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(f"{sharding.SEED}:{i}".encode()).hexdigest(), i, t))
    order = sorted(((k + 0.5) / len(v), s, h, i, t) for s, v in by.items() for k, (h, i, t) in enumerate(sorted(v)))
    n = len(order)
    want = []
    for place, (_, _, _, i, t) in enumerate(order):
        shard = place * 24 // n
        first = min(p for p in range(n) if p * 24 // n == shard)
        want.append((i, len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", shard, place - first, None))
    assert sorted(map(tuple, QUERIES["op5_sharding"](spark, SF).collect())) == sorted(want)


def test_secret_columns(spark, texts):
    for r in QUERIES["op6_secrets"](spark, SF).collect():
        found = [(secrets.KINDS[k], a, b) for a, k, b in secrets.spans_of(texts[r.doc_id])]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found if k != "pem")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in found) for kind in secrets.BASE)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def test_packing_is_best_fit(spark, texts):
    """Every task's pieces, in their order: each goes where least room stays, else
    into a new sequence, and the fullest closes when too many are open."""
    from tokenizers import Tokenizer
    import public_tokenizers
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: slow.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    rows = QUERIES["op7_packing"](spark, SF).collect()
    free, made = defaultdict(dict), set()
    for r in rows:
        own = free[r.sequence_id >> 32]
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length
        fitting = [f for f in own.values() if f >= r.length]
        if fitting:
            assert own[r.sequence_id] == min(fitting) and r.offset == 1024 - min(fitting)
        else:
            assert r.sequence_id not in made and r.offset == 0
            if len(own) == packing.OPEN_SEQUENCES and r.length < 1024:
                del own[min(own, key=own.get)]
            own[r.sequence_id] = 1024
        made.add(r.sequence_id)
        own[r.sequence_id] -= r.length
        if not own[r.sequence_id]:
            del own[r.sequence_id]
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


def test_added_token_in_a_text(spark):
    rows = packing.pack(frame(spark, [(1, "<|endoftext|>x")]), with_ids=True).collect()
    assert rows[0].ids[0] == 50256 and rows[0].ids[-1] == 2 and len(rows[0].ids) == 3


def test_repeated_passages_of_the_registered_query(spark, texts):
    words = {i: t.split() for i, t in texts.items()}
    runs = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k:k + 50])].add(i)
    holds = {i for r in runs.values() if len(r) > 1 for i in r if i != min(r)}
    found = QUERIES["op9_substring_dedup"](spark, SF).collect()
    assert holds <= {r.doc_id for r in found}
    for r in found:
        piece = texts[r.doc_id][r.start:r.end].split()
        assert r.n_words >= 25 and any(" ".join(piece[:20]) in " ".join(words[f]) for f in r.first_ids if f < r.doc_id)


def test_quality_columns(spark, texts):
    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    for r in QUERIES["op10_quality"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)
        assert abs(r.score - model.quality([texts[r.doc_id].encode()])[0]) < 1e-9


def test_a_label_is_learnt_from_a_late_line(spark):
    good = ["\n".join(prose(100 * i + k, 8) for k in range(90)) for i in range(40)]
    bad = ["\n".join([*t.split("\n")[:60], *["!!! $$ ## || 77"] * 60]) for t in good]
    df = frame(spark, list(enumerate(good + bad)))
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    s = {r.doc_id: r.score for r in quality.score(df, quality.train(df, labels)).collect()}
    assert min(s[i] for i in range(40)) > max(s[i] for i in range(40, 80))


def test_the_sample_is_bounded_by_its_bytes(spark):
    df = frame(spark, [(i, prose(i, 200)) for i in range(40)] + [(99, "x " * 100000)])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), 99]], "doc_id long, quality int")
    assert not quality.train(df, labels, train_bytes=1000).fitted
    assert quality.train(df, labels, train_bytes=100000).fitted
    with pytest.raises(ValueError):
        quality.score(quality.score(df, quality.LineField()), quality.LineField())


def test_near_duplicates_go_by_row(spark):
    a, b = prose(60, 150), prose(61, 150)
    near = a.split()
    near[70] = "other"
    rows = [(1, a), (5, " ".join(near)), (5, b), (7, b + " end"), (8, ""), (8, None), (9, prose(62, 90)), (9, prose(62, 90))]
    kept = sorted((r.doc_id, r.text or "") for r in near_dedup.drop_near_duplicates(frame(spark, rows)).collect())
    assert kept == sorted([(1, a), (5, b), (8, ""), (8, ""), (9, prose(62, 90))])
    same = [(3, a), (3, a), (3, " ".join(near))]
    left = near_dedup.drop_near_duplicates(frame(spark, same))
    assert left.count() == 1 and left.columns == frame(spark, same).columns


def test_repeats_go_by_row(spark):
    shared, other = prose(70, 60), prose(71, 60)
    rows = [(1, prose(72, 30) + " " + shared), (2, prose(73, 30) + " " + other), (5, shared + " " + prose(74, 80)),
            (5, other + " " + prose(75, 80)), (5, prose(76, 120)), (5, None)]
    left = [r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).filter("doc_id = 5").collect()]
    assert prose(76, 120) in left and None in left
    for t in left:
        if t and t != prose(76, 120):
            assert t.endswith(prose(74, 80)) or t.endswith(prose(75, 80))
            assert len(t) < len(prose(74, 80)) + 200


def test_every_link_of_a_page_counts(spark):
    pages = [(1, "http://plain.com/a/b.html?id=1", "<LINK REL='cAnonical' HREF='../x.html'><link rel=canonical href=http://bad.net/x>"),
             (2, "http://plain.com/x", ""), (3, "http://plain.com/a/b.html?id=2", None), (4, "http://bad.net/x", None),
             (4, "http://bad.net/x", "<a>"), (5, "http://s.com/", "<meta http-equiv='REFRESH' content='0;url=?p=2'>"),
             (6, "http://s.com/?p=2", "<meta content='0; url=//bad.net/q' http-equiv=refresh>"), (7, "http://bad.net/q#z", None),
             (8, "http://mail.com/", "<link rel=canonical href='mailto:x@bad.net'><link rel=canonical href='#top'>"), (9, "http://mail.com/b", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow"}
    empty = spark.createDataFrame([], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df, redirects=empty).collect()} == got


@pytest.mark.parametrize("target, want", [
    ("x.html", "http://h.com/a/x.html"), ("./x", "http://h.com/a/x"), ("../x", "http://h.com/x"), ("../../x?y#z", "http://h.com/x?y#z"),
    ("/q/./r/../s", "http://h.com/q/s"), ("?k=1", "http://h.com/a/b?k=1"), ("//o.org/p", "http://o.org/p"), ("HTTPS://O.org", "HTTPS://O.org"),
    ("javascript:void(0)", None), ("", None), ("..", "http://h.com/")])
def test_relative_targets(spark, target, want):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([(target, "http://h.com/a/b?q=1")], "t string, u string")
    assert row.select(url_filter.resolved(F.col("t"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize("most", [0, 100000])
def test_a_second_run_moves_only_unseen_texts(spark, scratch, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", most)
    df = frame(spark, planted())
    ledger = scratch + "/ledger"
    secrets.find_secrets(df, ledger).count()
    files = set(spark.read.parquet(ledger).inputFiles())
    more = frame(spark, [*planted(), (90, "token = abcdefgh12")])
    got = {r.doc_id: r.spans for r in secrets.find_secrets(more, ledger).collect()}
    assert len(got[90]) == 1
    new = [f for f in spark.read.parquet(ledger).inputFiles() if f not in files]
    assert spark.read.schema(secrets.LEDGER_SCHEMA).parquet(*new).count() == 1


def test_exact_dedup_of_the_smallest_set(spark, texts):
    rows = exact_dedup.find_duplicates(table(spark, SF, "documents")).collect()
    assert {r.doc_id: r.group_size for r in rows} == {
        i: sum("".join(t.split()) == "".join(o.split()) for o in texts.values()) for i, t in texts.items()}


def test_a_long_conversation_is_formatted_in_linear_time(spark):
    import time
    from parley.llm import chat_format
    from pyspark.sql import functions as F
    n = 30000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("t <é\\> "), F.col("id").cast("string")).alias("text"))
    on_path = chat_format.messages_by_turn(rows)
    began = time.time()
    r = chat_format.format_branches(on_path).select(chat_format.read_loss().alias("loss"), F.size("mask").alias("spans")).first()
    assert r.spans == n // 2 and r.loss == "".join(f"t <é\\> {i}" for i in range(1, n, 2))
    assert time.time() - began < 60


def test_many_blocks_read_the_corpus_once(spark, monkeypatch):
    """A benchmark of 50 blocks and more, one item in most documents, repeated rows
    and items, short items, null ids; the same marks as one automaton gives."""
    import random
    r = random.Random(12)
    items = [(i, prose(5000 + i, r.choice((3, 12, 30)))) for i in range(120)] + [(None, prose(5900, 15)), (7, None), (8, ""), (200, prose(5003, 30))]
    docs = []
    for i in range(150):
        held = [items[r.randrange(120)][1] for _ in range(r.randrange(3))] + ([items[1][1]] if i % 3 else [])
        docs.append((i, " ".join([prose(6000 + i, 20), *(h + ". " + prose(7000 + i, 9) for h in held)])))
    docs += [docs[1], docs[1], (None, docs[2][1]), (900, None), (901, "")]
    df = frame(spark, docs).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def rows(hits):
        return sorted(((x.doc_id, x.n_words, list(x.spans), list(x["items"])) for x in hits.collect()), key=str)
    one = rows(decontaminate.find_hits(df, bench))
    assert sum(bool(x[2]) for x in one) > 80
    monkeypatch.setattr(decontaminate, "GROUP", 20)
    reads = []
    monkeypatch.setattr(decontaminate, "_likely", lambda *a, f=decontaminate._likely: reads.append(1) or f(*a))
    assert rows(decontaminate.find_hits(df, bench, block_words=30)) == one and len(reads) == 1
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 16)   # a filter that lets much through changes nothing
    assert rows(decontaminate.find_hits(df, bench, block_words=200)) == one
    assert decontaminate.find_hits(df.limit(0), bench, block_words=30).count() == 0
