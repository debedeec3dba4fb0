"""A generated order-entry database of any number of warehouses, for load tests and invariants.

Every table is ``spark.range`` and column expressions: rows are made where they are needed, in parallel, and are the
same on every run. Money is DECIMAL(12,2); what is not yet delivered or carried is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.generators import char, last_name, non_uniform, text, uniform
from ledgerlake.functions.keys import CUSTOMERS, DISTRICTS, ITEMS

MONEY = "decimal(12,2)"
ORDERS, FIRST_OPEN = 3_000, 2_101  # orders of a district; from this number on they are open
SUPPLIERS = 10_000
#: Region names, by key from 1.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LOADED = "2020-01-01 00:00:00"


def _money(seed: str, low: int, high: int, *ids: Column) -> Column:
    """An amount of low..high cents."""
    return (uniform(seed, low, high, *ids).cast("decimal(18,0)") / 100).cast(MONEY)


def _per(spark: SparkSession, n: int, *sizes: int) -> tuple[DataFrame, list[Column]]:
    """One row for each combination of n by sizes, and its numbers (each from 1)."""
    total, parts, left = n, [], F.col("id")
    for s in reversed(sizes):
        parts.insert(0, (left % s + 1).cast("int"))
        left, total = F.floor(left / s), total * s
    return spark.range(total), [(left + 1).cast("int"), *parts]


def warehouse(spark: SparkSession, n: int) -> DataFrame:
    df, (w,) = _per(spark, n)
    return df.select(w.alias("w_id"), F.lit(300_000).cast(MONEY).alias("w_ytd"), (uniform("w_tax", 0, 2000, w) / 10_000).alias("w_tax"), text("w_name", 6, 10, w).alias("w_name"), text("w_city", 10, 20, w).alias("w_city"), char(text("w_state", 2, 2, w), 2).alias("w_state"), F.lit("123456789").alias("w_zip"))


def district(spark: SparkSession, n: int) -> DataFrame:
    df, (w, d) = _per(spark, n, DISTRICTS)
    return df.select(w.alias("d_w_id"), d.alias("d_id"), F.lit(30_000).cast(MONEY).alias("d_ytd"), F.lit(ORDERS + 1).alias("d_next_o_id"), (uniform("d_tax", 0, 2000, w, d) / 10_000).alias("d_tax"), text("d_name", 6, 10, w, d).alias("d_name"), F.lit("123456789").alias("d_zip"))


def customer(spark: SparkSession, n: int) -> DataFrame:
    df, (w, d, c) = _per(spark, n, DISTRICTS, CUSTOMERS)
    name = F.when(c <= 1000, c - 1).otherwise(non_uniform("c_last", 255, 173, 0, 999, w, d, c))
    return df.select(
        w.alias("c_w_id"), d.alias("c_d_id"), c.alias("c_id"), F.lit(-10).cast(MONEY).alias("c_balance"), F.lit(10).cast(MONEY).alias("c_ytd_payment"), F.lit(1).alias("c_payment_cnt"), F.lit(0).alias("c_delivery_cnt"),
        F.when(uniform("c_credit", 1, 10, w, d, c) == 1, "BC").otherwise("GC").alias("c_credit"), (uniform("c_discount", 1, 5000, w, d, c) / 10_000).alias("c_discount"), last_name(name).alias("c_last"), F.lit("OE").alias("c_middle"),
        text("c_first", 8, 16, w, d, c).alias("c_first"), text("c_city", 10, 20, w, d, c).alias("c_city"), text("c_state", 2, 2, w, d, c).alias("c_state"), F.lit("123456789").alias("c_zip"), text("c_phone", 16, 16, w, d, c).alias("c_phone"),
    )


def history(spark: SparkSession, n: int) -> DataFrame:
    df, (w, d, c) = _per(spark, n, DISTRICTS, CUSTOMERS)
    return df.select(w.alias("h_w_id"), d.alias("h_d_id"), c.alias("h_c_id"), F.lit(10).cast(MONEY).alias("h_amount"), F.to_timestamp_ntz(F.lit(LOADED)).alias("h_date"))


def _lines_of(w: Column, d: Column, o: Column) -> Column:
    return uniform("o_ol_cnt", 5, 15, w, d, o).cast("int")


def oorder(spark: SparkSession, n: int) -> DataFrame:
    df, (w, d, o) = _per(spark, n, DISTRICTS, ORDERS)
    # a permutation of the customers: a step that shares no factor with their number
    who = ((o - 1) * 1_237 + uniform("o_c_id", 0, CUSTOMERS - 1, w, d)) % CUSTOMERS + 1
    return df.select(w.alias("o_w_id"), d.alias("o_d_id"), o.alias("o_id"), who.cast("int").alias("o_c_id"), F.when(o < FIRST_OPEN, uniform("o_carrier", 1, 10, w, d, o)).cast("int").alias("o_carrier_id"), _lines_of(w, d, o).alias("o_ol_cnt"), F.lit(True).alias("o_all_local"), F.to_timestamp_ntz(F.lit(LOADED)).alias("o_entry_d"))


def new_order(spark: SparkSession, n: int) -> DataFrame:
    return oorder(spark, n).where(F.col("o_id") >= FIRST_OPEN).select(F.col("o_w_id").alias("no_w_id"), F.col("o_d_id").alias("no_d_id"), F.col("o_id").alias("no_o_id"))


def order_line(spark: SparkSession, n: int) -> DataFrame:
    o = oorder(spark, n).select("*", F.explode(F.sequence(F.lit(1), F.col("o_ol_cnt"))).alias("ol_number"))
    key = [F.col(c) for c in ("o_w_id", "o_d_id", "o_id", "ol_number")]
    done = F.col("o_id") < FIRST_OPEN
    return o.select(
        F.col("o_w_id").alias("ol_w_id"), F.col("o_d_id").alias("ol_d_id"), F.col("o_id").alias("ol_o_id"), "ol_number", uniform("ol_i_id", 1, ITEMS, *key).cast("int").alias("ol_i_id"), F.col("o_w_id").alias("ol_supply_w_id"),
        F.when(done, F.col("o_entry_d")).alias("ol_delivery_d"), F.when(done, F.lit(0).cast(MONEY)).otherwise(_money("ol_amount", 1, 999_999, *key)).alias("ol_amount"), F.lit(5).alias("ol_quantity"),
    )


def item(spark: SparkSession, items: int = ITEMS) -> DataFrame:
    df, (i,) = _per(spark, items)
    data = text("i_data", 25, 49, i)
    return df.select(i.alias("i_id"), text("i_name", 13, 23, i).alias("i_name"), _money("i_price", 100, 10_000, i).alias("i_price"), F.when(uniform("i_original", 1, 10, i) == 1, F.concat(F.substring(data, 1, 18), F.lit("ORIGINAL"))).otherwise(data).alias("i_data"), uniform("i_im_id", 1, 10_000, i).cast("int").alias("i_im_id"))


def stock(spark: SparkSession, n: int, items: int = ITEMS) -> DataFrame:
    df, (w, i) = _per(spark, n, items)
    zero = lambda c: F.lit(0).alias(c)
    return df.select(w.alias("s_w_id"), i.alias("s_i_id"), uniform("s_quantity", 10, 100, w, i).cast("int").alias("s_quantity"), zero("s_ytd"), zero("s_order_cnt"), zero("s_remote_cnt"))


def supplier(spark: SparkSession) -> DataFrame:
    df, (s,) = _per(spark, SUPPLIERS)
    part = lambda c, low, high: uniform(f"su_phone/{c}", low, high, s)
    return df.select(
        s.alias("su_suppkey"), F.ascii(text("su_nation", 1, 1, s)).alias("su_nationkey"), _money("su_acctbal", -99_999, 999_999, s).alias("su_acctbal"), F.format_string("Supplier#%09d", s).alias("su_name"),
        F.format_string("%02d-%03d-%03d-%04d", part("a", 10, 34), part("b", 100, 999), part("c", 100, 999), part("d", 1000, 9999)).alias("su_phone"), text("su_comment", 25, 40, s).alias("su_comment"),
    )


def nation(spark: SparkSession) -> DataFrame:
    """One nation for each letter or digit, under that character's code."""
    df, (k,) = _per(spark, 62)
    code = F.when(k <= 10, k + 47).when(k <= 36, k + 54).otherwise(k + 60).cast("int")
    return df.select(code.alias("n_nationkey"), (k % 5 + 1).alias("n_regionkey"), F.concat(F.lit("NATION_"), F.char(code)).alias("n_name"))


def region(spark: SparkSession) -> DataFrame:
    df, (k,) = _per(spark, len(REGIONS))
    return df.select(k.alias("r_regionkey"), F.element_at(F.array(*map(F.lit, REGIONS)), k).alias("r_name"))
