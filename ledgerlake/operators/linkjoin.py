"""Orders with their lines: three plans of one answer.

``nested`` stores lines inside their order, so that a query folds an array and neither joins nor shuffles; ``by_key``
is the equi-join; ``by_range`` meets lines through an encoded key range, with the range's block as the equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIDE = 16  # encoded line keys of an order lie within a range of this length


def nest(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """o_id and its lines as an array; orders without lines have an empty one."""
    edge = F.struct("ol_number", "ol_i_id", "ol_su_key", "ol_quantity", "ol_amount", "ol_delivery_d")
    per = lines.groupBy(F.col("ol_o_id").alias("o_id")).agg(F.collect_list(edge).alias("edges"))
    empty = F.array().cast(per.schema["edges"].dataType)
    return orders.select("o_id").join(per, "o_id", "left").select("o_id", F.coalesce("edges", empty).alias("edges"))


def nested(stored: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(28,2)")
    own = F.aggregate("edges", zero, lambda s, x: (s + x["ol_amount"]).cast("decimal(28,2)"))
    return stored.agg(F.sum(own).cast("double").alias("amount"), F.sum(F.size("edges")).cast("long").alias("n_lines"))


def by_key(orders: DataFrame, lines: DataFrame) -> DataFrame:
    j = lines.join(orders.select("o_id"), F.col("ol_o_id") == F.col("o_id"))
    return j.agg(F.sum("ol_amount").cast("double").alias("amount"), F.count("*").alias("n_lines"))


def by_range(orders: DataFrame, lines: DataFrame) -> DataFrame:
    spans = orders.select((F.col("o_id") * STRIDE).alias("lo"), (F.col("o_id") * STRIDE + STRIDE).alias("hi"), F.col("o_id").alias("block"))
    coded = lines.select((F.col("ol_o_id") * STRIDE + F.col("ol_number")).alias("k"), "ol_amount")
    coded = coded.withColumn("block", F.floor(F.col("k") / STRIDE))
    j = coded.join(spans, "block").where((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    return j.agg(F.sum("ol_amount").cast("double").alias("amount"), F.count("*").alias("n_lines"))


def lookup(lines: DataFrame, low: int, high: int) -> DataFrame:
    """Range scan: lines of orders low..high (exclusive); the bounds reach the Parquet scan."""
    return lines.where((F.col("ol_o_id") >= low) & (F.col("ol_o_id") < high))
