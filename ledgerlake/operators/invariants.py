"""Row invariants of the order-entry schema, counted in one pass a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def rules(table: str) -> dict[str, Column]:
    between = lambda x, low, high: c(x).between(low, high)
    return {
        "warehouse": {"zip": c("w_zip") == "123456789"},
        "district": {"zip": c("d_zip") == "123456789", "next_order": c("d_next_o_id") >= 3001},
        "customer": {"credit": c("c_credit").isin("BC", "GC"), "middle": c("c_middle") == "OE", "zip": c("c_zip") == "123456789"},
        "item": {"price": between("i_price", 1, 100)},
        "oorder": {"customer": between("o_c_id", 1, 3000), "carrier": c("o_carrier_id").isNull() | between("o_carrier_id", 1, 10), "lines": between("o_ol_cnt", 5, 15)},
        "order_line": {"item": between("ol_i_id", 1, 100_000), "number": between("ol_number", 1, 15)},
        "stock": {"quantity": between("s_quantity", 10, 100)},
    }[table]


def violations(df: DataFrame, table: str) -> DataFrame:
    """One row: rows, and for each rule how many rows break it (a rule that is null for a row is broken)."""
    return df.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules(table).items()))
