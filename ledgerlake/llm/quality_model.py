"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken with numpy over Arrow batches of whole texts. Spark's ``GBTClassifier``, which grows trees from
binned histograms, is fitted on a bounded sample of labelled rows; its trees are flattened into arrays, and scoring
walks all rows of a batch through a tree at once. One pass over the texts, no shuffle but the sample's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Words, documents_of, few_parts, materialize, mix, slices

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "longest_word", "upper", "digits", "symbols", "marks", "stops", "commas",
    "not_ascii", "lines_per_word", "distinct_words", "distinct_pairs", "distinct_grams", "same_as_before", "distinct_lines",
)
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@^~=+_{}[]\\/`", "!?", ".;:", ",")
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _members]] = _i + 1
_CLASS_OF[128:] = len(_CLASSES) + 1
_CLASS_OF[10] = len(_CLASSES) + 2


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    if not len(keys):
        return np.zeros(n)
    own = mix(keys + mix(text.astype(np.uint64)))
    order = np.argsort(own)
    sorted_ = own[order]
    first = np.ones(len(own), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    return np.bincount(text[order[first]], minlength=n).astype(float)


def statistics(texts: pa.Array, w: Words | None = None) -> np.ndarray:
    """One row of STATISTICS for each text (``w``: its words, if they are known); all finite, zeros for an empty text."""
    w, n = w or Words(texts), len(texts)
    size = np.diff(w.offsets).astype(float)
    words = np.diff(w.of).astype(float)
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    mean = _sums(length, w.of) * per_word
    spread = np.sqrt(np.maximum(_sums(length**2, w.of) * per_word - mean**2, 0))
    longest = np.zeros(n)
    some = np.flatnonzero(words)
    if len(some):
        longest[some] = np.maximum.reduceat(length, w.of[:-1][some])
    kinds = _CLASS_OF[w.raw]
    share = [_sums(kinds == k, w.offsets) for k in range(1, len(_CLASSES) + 3)]
    text = np.repeat(np.arange(n), np.diff(w.of))
    distinct = _distinct(w.hash, text, n)
    grams = []
    for k in (2, 4):
        at = w.gram_starts(k)
        grams.append(_distinct(w.grams(k)[at], text[at], n) / np.maximum(np.bincount(text[at], minlength=n), 1) if len(at) else np.zeros(n))
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    # lines: words of a line hashed together, by the number of line feeds before each word
    feeds = np.concatenate([[0], np.cumsum(w.raw == 10)])
    line = feeds[w.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    lines = np.bincount(text[heads], minlength=n).astype(float) if len(heads) else np.zeros(n)
    folded = np.add.reduceat(mix(w.hash + np.arange(len(w.hash), dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, len(w.hash)))).astype(np.uint64)), heads) if len(heads) else np.zeros(0, np.uint64)
    lines_apart = _distinct(folded, text[heads], n) if len(heads) else np.zeros(n)
    upper, digits, symbols, marks, stops, commas, beyond, newline = share
    return np.stack([
        np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), upper * per_byte, digits * per_byte, symbols * per_word, marks * per_word, stops * per_word, commas * per_word,
        beyond * per_byte, newline * per_word, distinct * per_word, *grams, _sums(same, w.of) * per_word, lines_apart / np.maximum(lines, 1),
    ], axis=1)


class Trees:
    """Trees as arrays: of node i of a tree, the statistic, the threshold, both children (a leaf's are itself), the value."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float], depth: int, constant: float | None = None):
        self.trees, self.weights, self.depth, self.constant = trees, weights, depth, constant

    @classmethod
    def of(cls, model) -> Trees:
        return cls([flatten(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), max((t.depth for t in model.trees), default=0))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))  # the loss that the trees were boosted for


def flatten(root) -> tuple[np.ndarray, ...]:
    """Arrays of a fitted regression tree, from its root node. All splits are of numbers."""
    nodes: list[list[float]] = []

    def read(node) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            nodes[me][:2] = [split.featureIndex(), split.threshold()]
            nodes[me][2:4] = [read(node.leftChild()), read(node.rightChild())]
        return me

    read(root)
    f, t, a, b, v = zip(*nodes, strict=True)
    return np.array(f, np.int32), np.array(t), np.array(a, np.int32), np.array(b, np.int32), np.array(v)


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    return docs.select("text", "label").mapInArrow(run, "label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000, trees: int = 30, depth: int = 4, bins: int = 64, step: float = 0.2) -> Trees:
    """Fit on about ``most_rows`` labelled rows at most, chosen by a hash of the id.

    Rows with a null id or label are no training rows; of several labels of an id the least counts. Without rows of both labels the score is a constant: the only
    label there is, or 0.5 where there is none.
    """
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    told = told.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Trees([], [], 0, float(next(iter(counts), 0.5)))
    share = min(1.0, most_rows / sum(counts.values()))
    if share < 1:
        told = told.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = materialize(_measured(documents_of(docs, id_col=id_col, text_col=text_col).join(F.broadcast(told), "doc_id")), "training")  # about most_rows pairs of numbers
    if rows.select("label").distinct().count() < 2:
        return Trees([], [], 0, float(rows.agg(F.coalesce(F.avg("label"), F.lit(0.5))).first()[0]))
    rows = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=step, minInstancesPerNode=5, featureSubsetStrategy="all", seed=1).fit(few_parts(rows))
    return Trees.of(model)


def score(docs: DataFrame, model: Trees, *, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and score (0 to 1, a function of the text alone), after the columns ``keep``.

    A null text is scored as an empty one, a null id stays null, repeated rows are scored each, no rows give none.
    """
    d = docs.select(*keep, F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kept = [f for f in d.schema.fields if f.name in keep]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                s = model.score(statistics(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), part.column("__id"), pa.array(s, pa.float64())], [*names, "__id", "__score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["__id long", "__score double"])
    out = d.mapInArrow(run, schema)
    return out.withColumnsRenamed({"__id": "doc_id", "__score": "score"}) if "doc_id" not in names else out.drop("__id").withColumnRenamed("__score", "score")


def held_out(doc_id) -> F.Column:
    """Rows that no label is learnt from: crc32 of the id as text has remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **fitting)
    s = score(docs, model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
