"""Connected components by minimum labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for the nodes of ``links`` (a, b); loops and repeats do no harm.

    A round gives each label the least label among its neighbours' and then follows labels once more, so rounds grow
    with the logarithm of the longest path in practice. Links between equal labels are dropped round by round.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    first = edges
    while not edges.isEmpty():
        # hook: each label takes the least label that an edge joins it to
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
        parent = materialize(both.groupBy("node").agg(F.min("label").alias("label")), "parents")
        while True:  # jump until every label points to a root
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            jumped = parent.join(up, "label", "left").select("node", F.coalesce("upper", "label").alias("label"), F.col("upper").isNotNull().alias("moved"))
            jumped = materialize(jumped, "parents")
            discard(parent)
            parent = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        to = parent.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = materialize(labels.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        a, b = (parent.select(F.col("node").alias(c), F.col("label").alias(f"{c}_root")) for c in ("a", "b"))
        left = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        left = materialize(left.where("a <> b").distinct(), "edges")
        for done in (labels, edges, parent):
            discard(done)
        labels, edges = after, left
    if edges is not first:
        discard(edges)
    return labels
