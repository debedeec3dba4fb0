"""Mixing to target weights with soft memberships.

A classifier fitted on a labelled table (Spark's multinomial logistic regression over hashed words and document
statistics) gives every document posteriors over domains. Nonnegative rates are then fitted so that the expected
tokens of each domain, sum of rate * tokens * posterior, match the targets: least squares by projected gradient, in
the metric in which an unconstrained step is exact. A document's rate after some steps depends on its posteriors and
the steps' gradients only, so a step is one distributed sum of as many numbers as there are domains, and nothing but
such sums passes the driver. A document is then drawn as many times as its rate says: whole copies, and one more with
the rest as its chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Words, documents_of, few_parts, materialize, mix, slices
from ledgerlake.llm.packing import encoder
from ledgerlake.llm.quality_model import STATISTICS, statistics

BUCKETS = 1 << 15  # of hashed words
_SHIFT = np.uint64(64 - 15)
ROWS_A_TASK = 250_000  # of the numbers that a gradient step reads


def _buckets(w: Words) -> np.ndarray:
    return (mix(w.hash) >> _SHIFT).astype(np.int32)


class Posteriors:
    """Softmax regression: coefficients (domains by buckets and statistics), intercepts; or the priors alone."""

    def __init__(self, names: list[str], coefficients: np.ndarray | None, intercepts: np.ndarray):
        self.names, self.coefficients, self.intercepts = names, coefficients, intercepts

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The posteriors of the domains of each text."""
        w = Words(texts)
        n = np.diff(w.of)
        logit = np.tile(self.intercepts, (len(n), 1))
        if self.coefficients is not None:
            at = _buckets(w)
            for i, row in enumerate(self.coefficients):
                total = np.concatenate([[0.0], np.cumsum(row[at])])
                logit[:, i] += (total[w.of[1:]] - total[w.of[:-1]]) / np.maximum(n, 1)
            logit += statistics(texts, w) @ self.coefficients[:, BUCKETS:].T
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_posteriors(docs: DataFrame, labelled: DataFrame, names: list[str], *, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Posteriors:
    """Fit on about ``most_rows`` rows of ``labelled`` (id, domain) at most, chosen by a hash of the id.

    Rows of null id or a domain that ``names`` lacks are left out; of several domains of an id the first of ``names``
    counts. What is broadcast is the sample's ids and domains. Without rows of two domains at least, posteriors are
    the shares of the labelled rows, or equal where there are none.
    """
    told = labelled.select(F.col(labelled.columns[0]).cast("long").alias("doc_id"), F.col(labelled.columns[1]).alias("domain"))
    number = F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("int") - 1
    told = told.withColumn("label", number).where("doc_id is not null and label >= 0").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    share = min(1.0, most_rows / max(1, sum(counts.values())))
    told = told.where(F.pmod(F.xxhash64("doc_id", F.lit("domains")), F.lit(1 << 20)) <= int(share * (1 << 20))).select("doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                at, stats = _buckets(w), statistics(part.column("text"), w)
                where, what = [], []
                for i, (a, b) in enumerate(zip(w.of[:-1], w.of[1:], strict=True)):
                    found, times = np.unique(at[a:b], return_counts=True)
                    where.append(np.concatenate([found, np.arange(BUCKETS, BUCKETS + len(STATISTICS), dtype=np.int32)]))
                    what.append(np.concatenate([times / max(b - a, 1), stats[i]]))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(where, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.float64()))], ["label", "i", "v"])

    rows = documents_of(docs, id_col=id_col, text_col=text_col).join(F.broadcast(told), "doc_id").select("text", "label").mapInArrow(run, "label int, i array<int>, v array<double>")
    rows = materialize(rows, "labelled")
    prior = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(prior) < 2:
        known = np.array([prior.get(i, 0) for i in range(len(names))], float)
        return Posteriors(names, None, np.log(np.maximum(known, 1e-9) if known.any() else np.ones(len(names))))
    sparse = F.udf(lambda i, v: Vectors.sparse(BUCKETS + len(STATISTICS), i, v), VectorUDT())  # a bounded sample's rows
    data = rows.select(F.col("label").cast("double").alias("label"), sparse("i", "v").alias("features"))
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(few_parts(data))
    # domains beyond the last label that was seen have no coefficients: as unlikely as the least likely one
    seen = model.coefficientMatrix.toArray()
    coefficients, intercepts = np.zeros((len(names), seen.shape[1])), np.full(len(names), -30.0)
    coefficients[: len(seen)], intercepts[: len(seen)] = seen, model.interceptVector.toArray()
    return Posteriors(names, coefficients, intercepts)


def _rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    r = np.ones(len(p))
    for y in steps:
        r = np.maximum(0.0, r - p @ y)
    return r


def fit_rates(members: DataFrame, targets: np.ndarray, *, most_steps: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Gradient steps (one row each) after which rates match the targets, from rows (tokens, p); and the expected tokens
    of each domain that these rates give."""
    k = len(targets)

    def summed(what) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    p = np.asarray(batch.column("p").flatten()).reshape(-1, k)
                    total = total + what(np.asarray(batch.column("tokens"), float), p)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        each = members.select("tokens", "p").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
        found = {r["i"]: r["s"] for r in each.groupBy("i").agg(F.sum("s").alias("s")).collect()}
        return np.array([found[i] for i in range(len(found))])

    gram = summed(lambda n, p: (p * n[:, None]).T @ p)
    steps = np.zeros((0, k))
    if not len(gram) or not gram.any():
        return steps, np.zeros(k)
    scale = np.linalg.pinv(gram.reshape(k, k))
    expected = lambda steps: summed(lambda n, p: (_rates(p, steps) * n) @ p)
    now, offs = expected(steps), []
    for _ in range(most_steps):
        offs.append(np.abs(now - targets).max() / max(targets.sum(), 1.0))
        if offs[-1] <= tolerance or (len(offs) > 5 and offs[-1] > offs[-6] - tolerance / 10):
            break  # met, or as near as it gets
        steps = np.vstack([steps, scale @ (now - targets)])
        now = expected(steps)
    return steps, now


def mix_to_targets(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    *,
    tokenizer_path: str,
    total: float = 1.0,
    whole: str | None = None,
    keep: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    fitting: dict | None = None,
    **stepping,
) -> DataFrame:
    """Per row of ``docs``: doc_id, tokens, p_<domain> for each of ``weights``, rate, residual, after the columns ``keep``.

    Tokens are those of the tokenizer's file, without special ones. Targets are ``weights``, scaled to sum to ``total`` times all tokens, or,
    with ``whole``, so that this domain's target is ``total`` times its own expected tokens. A rate is the expected
    number of times to take the document; every row gets one, and documents of the same posteriors get the same. Where
    the targets can't be met by nonnegative rates, these are the rates of least squares; ``residual`` is the greatest
    difference of a domain's expected tokens from its target, as a share of the target's sum. Null texts count as empty
    (no tokens), null ids stay null, repeated rows are members each, an empty table gives no rows; other columns than
    ``keep`` aren't read.

    The posteriors (with ``keep``) are written once to the shared folder; each step reads its numbers.
    """
    names = list(weights)
    model = fit_posteriors(docs, labelled, names, id_col=id_col, text_col=text_col, **(fitting or {}))
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    kept = [f for f in d.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "__text"):
                p = model(part.column("__text"))
                n = [len(encode.ids(t)) for t in part.column("__text").to_pylist()]
                cols = [*(part.column(f.name) for f in kept), part.column("__id"), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in kept), "doc_id", "tokens", "p"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "doc_id long, tokens long, p array<double>"])
    members = materialize(d.mapInArrow(run, schema), "members")
    rows = members.count()
    numbers = materialize(members.select("tokens", "p").coalesce(max(1, rows // ROWS_A_TASK)), "numbers")  # few files, since each step reads them
    sums = numbers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *(F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)) for i in range(len(names)))).first()
    wanted = np.array([weights[c] for c in names], float)
    if whole is None:
        targets = wanted / wanted.sum() * total * sums[0]
    else:
        targets = wanted / weights[whole] * total * sums[1 + names.index(whole)]
    steps, reached = fit_rates(numbers, targets, **stepping)
    residual = float(np.abs(reached - targets).max() / max(targets.sum(), 1.0))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("p").flatten()).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(p, steps))], [*batch.schema.names, "rate"])

    out = members.mapInArrow(rated, schema + ", rate double")
    told = [F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(names)]
    return out.select(*(F.col(f.name).alias(f.name.removeprefix("__keep_")) for f in kept), *(["doc_id"] if "doc_id" not in keep else []), "tokens", *told, "rate", F.lit(residual).alias("residual"))


def draw(rated: DataFrame, *by: str) -> DataFrame:
    """The rows of ``rated`` as many times as ``rate`` says: floor(rate) times, and once more with the rest as chance.

    The chance is a hash of the columns ``by``, so that a draw can be repeated; rows that agree in them are drawn alike.
    """
    chance = F.pmod(F.xxhash64(*by, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__copy")
