import random

import pytest

import corpus_pipeline
from pagemill.llm import decontaminate, language_id, secrets

from .test_documents import SENTENCES, brute_pairs
from .test_text_operators import PEM


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)

    def fresh(lang):
        return " ".join(rng.choice(SENTENCES[lang].split()) + rng.choice(["", "n", "s"]) for _ in range(50))

    rows = [(k, fresh(lang := sorted(SENTENCES)[k % 3]), lang) for k in range(120)]
    bench = [(1, " ".join(f"question{k} answer{k}" for k in range(10)))]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)]
    rows += [(300, fresh("en") + " " + bench[0][1], "en"), (301, fresh("fr") + " " + PEM, "fr"), (302, "12 34", "en"), (303, None, None), (304, "", None), (None, rows[30][1], None)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = ([tuple(r)[:3] for r in before.select("doc_id", "text", "lang").collect()], docs.collect())
    before, after = held["language_id"]
    model = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    accepted = {r.doc_id for r in language_id.identify(spark.read.parquet(f"{folder}/documents.parquet"), model).collect() if r.accepted}
    assert {r.doc_id for r in after} == accepted and not accepted & {302, 303, 304} and len(accepted) > 120
    before, after = held["ngram_jaccard_join"]
    pairs = brute_pairs(before, 0.5)
    assert {r.doc_id for r in after} == {r[0] for r in before} - {b for _, b in pairs}
    before, after = held["benchmark_decontamination"]
    assert {r[0] for r in before} - {r.doc_id for r in after} == {300}
    before, after = held["secret_scan"]
    assert len(before) == len(after) and [r.doc_id for r in after if secrets.MARK in r.text] == [301]
    before, after = held["packing"]
    assert sorted(r[0] or -1 for r in before) == sorted(r.doc_id or -1 for r in after)
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_empty_and_unlabelled_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    plain = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars", "1 AS group_id", "2 AS lowered")
    assert corpus_pipeline.identify_language(spark, plain, folder).count() == docs.count()
    assert corpus_pipeline.drop_near_duplicates(spark, plain, folder).columns == plain.columns


def test_stage_wiring_uses_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "packing"]
    assert decontaminate.LEAKS.startswith("doc_id")
