"""The registered queries against their SQL, and the contracts of those without, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from repolens.llm import queries

from ..test_catalog import TABLES, duck, rows_of  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the generated tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    frame = queries.queries()[name](spark, TABLES)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(list(want.columns), want.fetchall())


COLUMNS = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "n_repeated": "bigint"},
    "op6_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    frame = queries.queries()[name](spark, TABLES)
    kinds = dict(frame.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    assert frame.count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()


def test_ten_operators_are_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", ["op1_mix_sources", "op7_quality_rules"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
