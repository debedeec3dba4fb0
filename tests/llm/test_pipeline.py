"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as pipeline
import numpy as np
import pytest
from ledgerlake.llm import mixing, packing, quality_model, registry, similarity_join, substring_dedup
from ledgerlake.llm.common import materialize
from pyspark.sql import functions as F

from tests.llm.test_similarity import brute_components, brute_removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns_and_shrink(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "mixing_to_target_weights", "packing"]
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.schema.simpleString() == before.schema.simpleString() and 0 < after.select("doc_id").distinct().count() <= before.count()


def test_classifier_stage_keeps_what_scores_well(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    told = labels.collect()
    right = [(r.doc_id in kept) == (r.quality == 1) for r in told]
    assert sum(right) / len(right) > 0.9


def test_join_stage_keeps_one_of_each_group(stages, words):
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {d for d, _, c in brute_components(docs, words, 5, 80, False) if c == d}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_dedup_stage_cuts_what_brute_force_cuts(stages, words):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {d: t for d, n, gone, t in brute_removed(before, words, 50) if gone < n or gone == 0}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert {d: " ".join(words(r.text)) for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mixing_stage_keeps_clean_documents(spark, stages):
    clean = {r.doc_id for r in registry.domains(spark.read.parquet(f"{SF}/labels.parquet")).where("domain = 'clean'").collect()}
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in stages[3:5])
    assert clean & before <= after


def test_mixing_stage_meets_its_targets(spark, stages):
    told = registry.domains(spark.read.parquet(f"{SF}/labels.parquet"))
    rated = mixing.mix_to_targets(stages[3], told, pipeline.WEIGHTS, tokenizer_path=pipeline.TOKENIZER, total=pipeline.WHOLE, whole="clean", keep=pipeline.COLUMNS)
    rated = materialize(rated, "rated")
    sums = lambda df, by: np.array(df.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{c}") * by), F.lit(0.0)) for c in pipeline.WEIGHTS)).first())
    there = sums(rated, F.lit(1))
    weights = np.array(list(pipeline.WEIGHTS.values()))
    target = weights / weights[0] * pipeline.WHOLE * there[0]
    drawn = mixing.draw(rated, "doc_id", "text")
    assert np.abs(sums(rated, F.col("rate")) - target).max() <= 0.001 * target.sum()
    assert np.abs(sums(drawn, F.lit(1)) - target).max() <= 0.05 * target.sum()  # of 200 documents or so
    assert drawn.select(*pipeline.COLUMNS).exceptAll(stages[4]).count() == 0 == stages[4].exceptAll(drawn.select(*pipeline.COLUMNS)).count()


def test_draw_takes_whole_copies_and_a_chance_copy(spark):
    rated = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 4 * 0.75).alias("rate"))
    times = {r.doc_id: r["count"] for r in mixing.draw(rated, "doc_id", "text").groupBy("doc_id").count().collect()}
    for i, rate in enumerate((0.0, 0.75, 1.5, 2.25)):
        own = [times.get(d, 0) for d in range(i, 4000, 4)]
        assert set(own) <= {int(rate), int(rate) + 1} and abs(sum(own) / 1000 - rate) < 0.06


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd, k):
    rows = odd.select(*pipeline.COLUMNS, F.col("label").alias("rate"), F.col("h").alias("kept"))
    stage = pipeline.STAGES[k][1]
    got = materialize(stage(spark, rows, SF), "odd")
    assert stage(spark, rows.where("false"), SF).count() == 0
    if k in (1, 2):
        assert got.where("doc_id is null").count() == 1  # nothing is known to be a copy without an id
    if k == 4:
        assert got.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == rows.select("doc_id").distinct().count()


def test_join_stage_judges_texts_of_one_id_each(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (7, "x"), (None, a)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars"), "docs")
    for stage in (pipeline.ngram_jaccard_join, pipeline.substring_dedup_stage):
        got = sorted(((r.doc_id or 0, r.text) for r in stage(spark, docs, SF).collect()))
        assert got == sorted([(1, a), (5, b), (7, "x"), (0, a)])


def test_packing_stage_holds_every_document(stages):
    docs = {r.doc_id for r in stages[4].select("doc_id").collect()}
    times = stages[4].groupBy("doc_id").agg(F.count("*").alias("times"))
    sums = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).join(times, "doc_id").collect()
    assert {r.doc_id for r in sums} == docs and all(r.n == r["all"] * r.times for r in sums)




def _python_in_one_task(plan) -> tuple[int, int]:
    """How many Python operators the tasks of a physical plan's last stage run, and the most that those of any stage do."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _python_in_one_task(plan.executedPlan())
    below = [_python_in_one_task(plan.children().apply(i)) for i in range(plan.children().size())]
    here = max((n for n, _ in below), default=0) + any(x in plan.nodeName() for x in ("InArrow", "InPandas", "EvalPython"))
    most = max([here, *(n for _, n in below)])
    return (0 if "Exchange" in plan.nodeName() else here), most


@pytest.mark.parametrize("k", range(5))
def test_a_task_of_a_stage_has_one_python_worker(spark, stages, monkeypatch, k):
    """Workers are kept and used in turn, so with two in a task an executor has two for each core from then on."""
    seen = {}

    def noted(df, name):
        seen[name] = max(seen.get(name, 0), _python_in_one_task(df._jdf.queryExecution().executedPlan())[1])
        return materialize(df, name)

    for module in (mixing, packing, quality_model, similarity_join, substring_dedup):
        monkeypatch.setattr(module, "materialize", noted)
    name, stage = pipeline.STAGES[k]
    noted(stage(spark, stages[k], SF), name)
    assert max(seen.values()) == 1, seen
