"""Plan properties: no cartesian products of rows; nested-loop joins only with a
one-row side (fitted figures) or of blocks against blocks (top-k tiles);
filters and column pruning reach the parquet scan."""

import pytest

import __spark_entry__ as E
from parley.plans import catalog

from conftest import SF_SMALL

ML = {"reward_model_eval", "score_pairs", "pairwise_preference"}
BOUNDED_NESTED_LOOP = {"eval_results", "semantic_topk"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - ML))
def test_no_cartesian(spark, key):
    p = _plan(E.queries()[key](spark, SF_SMALL))
    if key != "semantic_topk":
        assert "CartesianProduct" not in p
    if key not in BOUNDED_NESTED_LOOP:
        assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p          # no row-at-a-time Python UDFs


def test_pushdown_and_pruning(spark):
    df = E.queries()["toxicity_check"](spark, SF_SMALL)
    p = _plan(df)
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in p
    d = E.queries()["feedback_dataset"](spark, SF_SMALL)
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in _plan(d)


def test_every_query_is_described():
    from parley.plans.descriptions import DESCRIPTIONS
    assert set(DESCRIPTIONS) == set(catalog.queries())


def test_task_code_is_pickled_by_value():
    """Executors need no installed copy of the package (mapInPandas scans,
    top-k kernel and stream processors travel with the task)."""
    import pickle

    from pyspark import cloudpickle

    import parley  # noqa: F401  (registers the package)
    from parley.operators.requests import rate_limit_fold
    assert "parley" in cloudpickle.cloudpickle._PICKLE_BY_VALUE_MODULES
    fn = pickle.loads(cloudpickle.dumps(rate_limit_fold))
    allowed, remaining, _ = fn([0, 1, 2], 2, 10, None)
    assert list(allowed) == [True, True, False] and list(remaining) == [1, 0, 0]


def test_response_scores_computed_once_for_both_pair_sides(spark):
    df = E.queries()["preference_pairs"](spark, SF_SMALL)
    df.collect()
    # Both sides read the scores that were written once, and nothing else.
    files = df.inputFiles()
    assert files and all("parley-written" in f for f in files)


def test_top_n_per_group_limits_before_the_shuffle(spark):
    p = _plan(E.queries()["conversation_context"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("key", ["alert_error_rate", "alert_latency"])
def test_alerts_read_the_log_once(spark, key):
    p = _plan(E.queries()[key](spark, SF_SMALL))
    assert p.count("FileScan") == 1 and "Join" not in p


def test_dispatch_joins_no_day_count(spark):
    p = _plan(E.queries()["dispatch_tasks"](spark, SF_SMALL))
    assert "NestedLoop" not in p
    assert not any("Join" in line and "days_old" in line for line in p.splitlines())


def test_chunk_log_is_built_in_one_scan(spark):
    p = _plan(E.queries()["assemble_chunks"](spark, SF_SMALL))
    assert p.count("FileScan") == 1 and "REPARTITION_BY" not in p
