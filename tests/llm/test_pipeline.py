"""The pipeline's stages against brute force on the smallest data set."""

import duckdb
import pytest

import corpus_pipeline as C
from parley.llm import decontaminate, exact_dedup, near_dedup, queries
from parley.llm.common import save, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, f in C.STAGES[:-1]:
        out[name] = (docs, docs := save(f(spark, docs, SF)))
    return out | {"packing": (docs, save(C.STAGES[-1][1](spark, docs, SF)))}


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(spark, stages):
    want = table(spark, SF, "documents").schema
    for name, _ in C.STAGES[:-1]:
        assert stages[name][1].schema == want


def test_quality_rejects_bad_and_keeps_good(spark, stages):
    before, after = map(rows, stages["quality"])
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels[i] == 1 for i in before if i in labels and i not in after) == 0
    assert sum(labels[i] == 0 for i in after if i in labels) <= 1


def test_exact_dedup_leaves_one_of_each_text(stages):
    before, after = map(rows, stages["exact_dedup"])
    best = {}
    for i, t in before.items():
        key = "".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None})
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert set(after) == {i for _, i in best.values()}


def test_near_dedup_leaves_one_of_each_group(stages):
    from test_llm_ops import brute_near
    before, after = map(rows, stages["near_dedup"])
    want = brute_near(list(before.items()), near_dedup.SHINGLE)
    assert set(after) == {i for i, _, c in want if i == c}


def test_no_benchmark_passage_is_left(spark, stages):
    before, after = map(rows, stages["decontaminate"])
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {x[0] for x in decontaminate.brute_force(list(before.items()), items) if x[2]}
    assert not any(x[2] for x in decontaminate.brute_force(list(after.items()), items))
    assert all(after[i] == t for i, t in before.items() if i not in hit)


def test_packing_holds_every_document(stages):
    docs, packed = stages["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows(docs))


def test_run_gives_the_same_pieces(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, C.run(spark, SF).select(key).collect())) == sorted(map(tuple, stages["packing"][1].select(key).collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    from scripts_check import digest
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    got, cur = [tuple(r) for r in df.collect()], con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert digest(df.columns, got)[0] == digest(names, cur.fetchall())[0]


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_stages_work_on_slices_of_a_batch(spark, monkeypatch):
    """However many rows Spark sends at once, a stage makes Python objects and results of a bounded part of their texts."""
    from types import SimpleNamespace

    import pyarrow as pa
    from parley.llm import packing, quality
    from parley.llm.common import text_slices

    lengths = [0, 5, 300000, 0, 0, 7, 700000, 3] + [20000] * 80 + [0]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(lengths))), "text": [None if n == 5 else ("word %d " % n * n)[:n] for n in lengths]})
    size = 1 << 18
    parts = list(text_slices(iter([batch, batch.slice(0, 0)]), 1, size))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    for p in parts:
        assert sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < size
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "some words of an item that no text has at all")], "item_id long, text string")
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run) or self)
    monkeypatch.setattr("pyspark.TaskContext.get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    quality.score(docs, quality.LineField())
    packing.pack(docs, with_ids=True)
    decontaminate.clean(docs, item)
    assert len(found) == 3
    for run in found:
        out = list(run(iter([batch])))
        assert len(out) > 1
        ids = pa.Table.from_batches(out)["doc_id"].to_pylist()
        assert list(dict.fromkeys(ids)) == list(range(len(lengths)))
