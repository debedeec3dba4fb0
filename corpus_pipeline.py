"""A corpus pipeline of five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import mixing, packing, quality_model, similarity_join, substring_dedup
from ledgerlake.llm.common import Scope, delete, discard, folders_of, materialize, table
from ledgerlake.llm.registry import domains

#: What tokens shall be of (the classifier has left next to none of low quality, so more can't be asked for); as many
#: clean tokens are taken as WHOLE times what there are, so that every clean document stays.
WEIGHTS, WHOLE = {"clean": 0.97, "toxic": 0.03, "low": 0.0}, 1.05
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")  # tokens are mixed and packed alike
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []  # intermediate tables of stages whose result has been written since


def staged(stage: Stage) -> Stage:
    """A stage gets what the one before it gave as a written table, so that one's intermediate tables can go."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = folders_of(docs)
        if not any(at.rsplit("/", 1)[1] in {x.rsplit("/", 1)[1] for x in read} for at in _LEFT):
            delete(spark, _LEFT)
            _LEFT.clear()
        with Scope(spark) as scope:
            out = stage(spark, docs, sf_dir)
            scope.kept |= {at.rsplit("/", 1)[1] for at in scope.made}
        _LEFT.extend(scope.made)
        return out

    return run


@staged
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of labelled quality rejects (score under 0.5) go."""
    labels = table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out(F.col("doc_id"))))
    return quality_model.score(docs, model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


@staged
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the smallest id stays."""
    linked = similarity_join.link(docs)
    text = F.xxhash64(F.coalesce("text", F.lit("")))  # tells texts of one id apart
    gone = linked.where("component_id < doc_id").select("doc_id", "text_key").distinct()
    some = docs.where("doc_id is not null").withColumn("text_key", text).join(gone, ["doc_id", "text_key"], "left_anti")
    return some.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


@staged
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; documents of which nothing is left go."""
    kept = substring_dedup.remove_repeats(docs, keep=("lang", "source")).where("n_removed < n_words or n_removed = 0")
    return kept.select("doc_id", "text", "kept.lang", "kept.source", F.length("text").cast("long").alias("n_chars"))


@staged
def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is taken as many times as its rate says; the part of a copy is a chance, by a hash of its id and text."""
    told = domains(table(spark, sf_dir, "labels"))
    rated = mixing.mix_to_targets(docs, told, WEIGHTS, tokenizer_path=TOKENIZER, total=WHOLE, whole="clean", keep=COLUMNS)
    return mixing.draw(rated, "doc_id", "text").select(*COLUMNS)


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as training sequences; one row for each piece, with its ids."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup_stage),
    ("mixing_to_target_weights", mixing_to_target_weights),
    ("packing", packing_stage),
]

#: SQL can express neither trained models nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
