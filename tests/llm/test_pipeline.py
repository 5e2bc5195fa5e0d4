"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline

from .test_operators import BASE, TEXTS, check_mix, edited, expected_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    item = prose(77, 40)
    rows = [(i, prose(i + 500, 90) if t is None else t, "en", f"src{i % 4}", 0) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, prose(700 + i, 60), "en", f"src{i % 9}", 0) for i in range(60)]
    rows += [(200, prose(1, 30) + " " + item + " " + prose(2, 30), "en", "src1", 0), (201, edited(BASE, 50, 0.004), "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(78, 30))], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        rows = [r.asDict() for r in docs.collect()]
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        before[name] = (rows, [r.asDict() for r in docs.collect()])
    ids = lambda rows: {r["doc_id"] for r in rows}
    came, left = before["language_id"]
    assert {1, 2} & ids(came) - ids(left) == {1, 2} and ids(left) >= set(range(100, 160))
    came, left = before["near_dedup"]
    want = expected_components([(r["doc_id"], r["text"]) for r in came], 5, 80)
    assert ids(left) == {i for i, c in want.items() if i == c}
    came, left = before["substring_dedup"]
    assert ids(left) == ids(came)
    clean = {r["doc_id"]: r["text"] for r in came if 100 <= r["doc_id"] < 160}
    assert {r["doc_id"]: r["text"] for r in left if r["doc_id"] in clean} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in left)
    came, left = before["decontaminate"]
    assert ids(came) - ids(left) == {200}
    came, left = before["mix_sources"]
    assert ids(left) == ids(came) and len(left) == len(came)
    check_mix(left, {f"src{i}": 8 if i < 5 else 5 for i in range(10)}, 1, 16)
    assert pipeline.run(spark, folder).count() == len(left)


def test_substring_stage_reaches_every_passage_of_over_50_words(spark):
    item = prose(90, 51)
    assert len(item) < 400
    rows = [(i, prose(800 + i, 70) + " " + item + " " + prose(900 + i, 70), 0) for i in range(2)]
    out = pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), "").collect()
    assert len(out) == 2 and not any(item in r["text"] for r in out) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert all(r["text"].startswith(prose(800 + r["doc_id"], 70)) and r["text"].endswith(prose(900 + r["doc_id"], 70)) for r in out)


def test_stages_keep_columns_of_any_name(spark, folder):
    """Extra columns with names that the stages use themselves, nulls in every column, repeated rows, an empty table."""
    names = ["__k", "__d", "__s", "__h", "__t", "__text", "__starts", "phase_", "rest_", "a.b", "k", "wanted", "doc"]
    rows = [(300 + i, prose(300 + i, 60), "en", "src1", 0) for i in range(4)] + [(303, prose(303, 60), "en", "src1", 0), (None, prose(330, 60), None, None, None), (340, None, None, None, None), (341, "", "en", "src1", 0)]
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = [r.asDict() for r in out.collect()]
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names), name
        assert {r["doc_id"] for r in got} >= {None, 300, 301, 302, 303}, name
        assert stage(spark, docs.where("doc_id < 0"), folder).count() == 0, name


def test_language_stage_keeps_texts_of_several_languages(spark):
    words = {"aa": ["bakolu", "mirate", "sanopi", "tulega"], "bb": ["xyzzyq", "wqvrrk", "zzkwpt", "qqjhxv"], "cc": ["straße", "größer", "höhlen", "müßig"]}
    text = lambda lang, n: " ".join(words[lang][i % 4] for i in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate([*words] * 20)]
    rows += [(900, " ".join(text(lang, 12) for lang in words), None), (901, "漢字" * 40, None), (902, "1234 5678", None)]
    left = {r["doc_id"] for r in pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "").collect()}
    assert left == set(range(60)) | {900}
