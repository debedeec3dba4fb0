"""Sources: fixture tables with explicit columns, the logical order-entry views over them, and sinks.

Views are plain projections: filters and column choices above them reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.snapshots import as_of as snapshot

MONEY = "decimal(18,2)"
EPOCH_DAYS = 90  # of the change logs: deliveries of lines, entries of orders
ORDER = ("o_c_id", "o_entry_d", "o_carrier_id", "o_status")
LINE = ("ol_o_id", "ol_number", "ol_i_id", "ol_su_key", "ol_quantity", "ol_amount", "ol_delivery_d", "ol_w_id")


def epoch_of(day: Column) -> Column:
    return F.floor(F.date_diff(day.cast("date"), F.lit("1995-01-01").cast("date")) / EPOCH_DAYS + 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Copy a table to Parquet; files are replaced as a whole, so that a retry does no harm."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def build_index(df: DataFrame, path: str, key: str) -> None:
    """Store rows in ranges of ``key``, sorted: lookups of keys and ranges read the files and row groups that have them."""
    write(df.repartitionByRange(key).sortWithinPartitions(key), f"{path}/put=0")


def put_index(df: DataFrame, path: str, key: str, batch: int) -> None:
    """Add rows to an index as batch 1, 2, ...; doing a batch again replaces it."""
    write(df.repartitionByRange(key).sortWithinPartitions(key), f"{path}/put={batch}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("put")


def line_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines before any delivery, and the log of their deliveries; a line is known by a hash of what never changes."""
    c = F.col
    line = F.xxhash64("ol_o_id", "ol_number", "ol_i_id", "ol_su_key", "ol_quantity", "ol_amount", "__shipped").alias("line_id")
    lines = order_line(spark, sf_dir, shipped=True)
    base = lines.select(line, *(F.lit(None).cast("timestamp_ntz").alias(x) if x == "ol_delivery_d" else c(x) for x in LINE))
    done = lines.where(c("ol_delivery_d").isNotNull())
    values = [c(x) if x == "ol_delivery_d" else F.lit(None).cast(lines.schema[x].dataType).alias(x) for x in LINE]
    log = done.select(epoch_of(c("ol_delivery_d")).alias("epoch"), F.lit(1).cast("long").alias("seq"), line, F.lit("U").alias("op"), F.array(F.lit("ol_delivery_d")).alias("changed"), *values)
    return base, log


def order_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """No orders, and the log of their inserts."""
    orders = oorder(spark, sf_dir)
    every = F.array(*map(F.lit, ORDER))
    log = orders.select(epoch_of(F.col("o_entry_d")).alias("epoch"), F.lit(1).cast("long").alias("seq"), "o_id", F.lit("I").alias("op"), every.alias("changed"), *ORDER)
    return orders.where("false"), log


def order_line(spark: SparkSession, sf_dir: str, *, delivered: bool = False, as_of: int | None = None, shipped: bool = False) -> DataFrame:
    """Lines of orders; ol_delivery_d is null until delivered. (order, number) is not unique in the fixtures.

    ``delivered`` keeps delivered lines only, by filters on stored columns, which the scan takes over. ``as_of`` reads
    them at an epoch of the log of deliveries (None: the newest, which is what is stored).
    """
    c = F.col
    if as_of is not None:
        found = snapshot(*line_log(spark, sf_dir), as_of, key="line_id", columns=LINE).drop("line_id")
        return found.where(c("ol_delivery_d").isNotNull()) if delivered else found
    lines = read(spark, sf_dir, "lineitem")
    if delivered:
        lines = lines.where((c("l_linestatus") == "F") & c("l_shipdate").isNotNull())
    return lines.select(
        c("l_orderkey").alias("ol_o_id"),
        c("l_linenumber").alias("ol_number"),
        c("l_partkey").alias("ol_i_id"),
        c("l_suppkey").alias("ol_su_key"),
        c("l_quantity").alias("ol_quantity"),
        c("l_extendedprice").cast(MONEY).alias("ol_amount"),
        F.when(c("l_linestatus") == "F", c("l_shipdate")).alias("ol_delivery_d"),
        (1 + c("l_suppkey") % 10).alias("ol_w_id"),
        *([c("l_shipdate").alias("__shipped")] if shipped else []),
    )


def oorder(spark: SparkSession, sf_dir: str, *, as_of: int | None = None) -> DataFrame:
    """Orders, at an epoch of the log of their inserts (None: the newest, which is what is stored)."""
    c = F.col
    if as_of is not None:
        return snapshot(*order_log(spark, sf_dir), as_of, key="o_id", columns=ORDER)
    return read(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("o_id"),
        c("o_custkey").alias("o_c_id"),
        c("o_orderdate").alias("o_entry_d"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("o_carrier_id"),
        c("o_orderstatus").alias("o_status"),
    )


def new_order(spark: SparkSession, sf_dir: str, *, as_of: int | None = None) -> DataFrame:
    return oorder(spark, sf_dir, as_of=as_of).where(F.col("o_status") == "O")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "customer").select(
        c("c_custkey").alias("c_id"), c("c_name").alias("c_last"), "c_nationkey", c("c_acctbal").cast(MONEY).alias("c_balance"), c("c_mktsegment").alias("c_state"), (c("c_nationkey") % 10).alias("c_phone0")
    )


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("i_id"), c("p_name").alias("i_name"), c("p_retailprice").alias("i_price"), F.concat_ws(" ", "p_type", "p_name").alias("i_data"))


def stock_quantity(item: Column, supplier: Column) -> Column:
    return 10 + (item * 7 + supplier * 13) % 91


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (item, supplier) that was ever ordered."""
    pairs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("s_i_id"), F.col("l_suppkey").alias("s_su_key")).agg(F.count("*").alias("s_order_cnt"))
    return pairs.withColumn("s_quantity", stock_quantity(F.col("s_i_id"), F.col("s_su_key")))


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("su_suppkey"), c("s_name").alias("su_name"), c("s_nationkey").alias("su_nationkey"), c("s_acctbal").alias("su_acctbal"))


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation")


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region")


#: The same views for DuckDB; statements of the registry are prefixed with those they name.
SQL_VIEWS = {
    "order_line": """SELECT l_orderkey AS ol_o_id, l_linenumber AS ol_number, l_partkey AS ol_i_id, l_suppkey AS ol_su_key, l_quantity AS ol_quantity,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS ol_amount, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS ol_delivery_d, 1 + l_suppkey % 10 AS ol_w_id FROM lineitem""",
    "oorder": """SELECT o_orderkey AS o_id, o_custkey AS o_c_id, o_orderdate AS o_entry_d, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_carrier_id, o_orderstatus AS o_status FROM orders""",
    "cust": """SELECT c_custkey AS c_id, c_name AS c_last, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_balance, c_mktsegment AS c_state, c_nationkey % 10 AS c_phone0 FROM customer""",
    "item": """SELECT p_partkey AS i_id, p_name AS i_name, p_retailprice AS i_price, p_type || ' ' || p_name AS i_data FROM part""",
    "stock": """SELECT l_partkey AS s_i_id, l_suppkey AS s_su_key, count(*) AS s_order_cnt, 10 + (l_partkey * 7 + l_suppkey * 13) % 91 AS s_quantity FROM lineitem GROUP BY ALL""",
    "supp": """SELECT s_suppkey AS su_suppkey, s_name AS su_name, s_nationkey AS su_nationkey, s_acctbal AS su_acctbal FROM supplier""",
}


#: What readers at an epoch see instead, from the stored rows alone.
_DAYS = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE)) // 90 + 1 <= {}"
AS_OF_VIEWS = {
    "order_line": lambda v: SQL_VIEWS["order_line"].replace("l_linestatus = 'F' THEN", f"l_linestatus = 'F' AND {_DAYS.format('l_shipdate', v)} THEN"),
    "oorder": lambda v: SQL_VIEWS["oorder"] + f" WHERE {_DAYS.format('o_orderdate', v)}",
}


def with_views(sql: str, as_of: int | None = None) -> str:
    views = SQL_VIEWS if as_of is None else SQL_VIEWS | {name: at(as_of) for name, at in AS_OF_VIEWS.items()}
    used = [f"{name} AS ({body})" for name, body in views.items() if f" {name}" in sql]
    return ("WITH " + ", ".join(used) + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else " " + sql)) if used else sql
