"""The effects of the five transactions: rows after a batch, and the change-log entries that a batch writes.

Spark is no transaction processor: what a batch of committed transactions does to the tables is computed set-wise. The
``*_entries`` functions give for each table the log entries of a batch, in the form that ``snapshots.as_of`` and
``snapshots.moved_on`` read: one entry a key and batch, with the values after the batch. Lines are inserted one by one
and dated by order (key ol_o_id), since a delivery dates all lines of its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def stock_after(quantity: Column, ordered: Column) -> Column:
    """Stock after an order: refilled by 91 where fewer than ten would be left."""
    return F.when(quantity - ordered >= 10, quantity - ordered).otherwise(quantity - ordered + 91)


def new_order_stock(lines: DataFrame, stock: DataFrame, *, most: int = 91) -> DataFrame:
    """Stock rows after a batch of new order lines.

    A step takes a quantity of at most 91 from a stock of 10 to 100 and refills by 91, so it stays in that range and is
    a subtraction modulo 91: any number of steps, in any order, is one sum, which is aggregated before the shuffle.
    Rows for which this doesn't hold (another stock, a quantity under 0 or over 91) are refused.
    """
    q = c("ol_quantity").cast("long")
    per = lines.groupBy("ol_i_id", "ol_su_key").agg(F.sum(q).alias("taken"), F.count("*").alias("n"), F.min(q).alias("least"), F.max(q).alias("largest"))
    j = stock.join(per, (c("s_i_id") == c("ol_i_id")) & (c("s_su_key") == c("ol_su_key")))
    before = c("s_quantity").cast("long")
    fits = before.between(10, 100) & (c("least") >= 0) & (c("largest") <= most)
    after = F.when(fits, F.lit(10) + F.pmod(before - c("taken") - 10, F.lit(91))).otherwise(F.raise_error(F.lit("stock of 10 to 100 and quantities of 0 to 91 expected")).cast("long"))
    return j.select("s_i_id", "s_su_key", after.alias("s_quantity"), c("taken").alias("s_ytd"), c("n").alias("s_order_cnt"))


def payment_customer(customers: DataFrame, by_name: DataFrame, *, group: list[str], order: str) -> DataFrame:
    """The customer that a payment by last name means: the middle one (rounded up) of those with the name, by ``order``."""
    w = Window.partitionBy(*group).orderBy(order, "c_id")
    ranked = customers.join(by_name.select(*group).distinct(), group).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    return ranked.where(c("rn") == F.floor((c("n") + 1) / 2)).drop("rn", "n")


def payment(customers: DataFrame, payments: DataFrame, *, most_data: int = 500) -> DataFrame:
    """Customers after a batch of payments (c_id, amount, seq): balance, year-to-date payment, count; bad credit keeps a note."""
    per = payments.groupBy("c_id").agg(F.sum("amount").alias("paid"), F.count("*").alias("n"), F.max_by("amount", "seq").alias("last"))
    note = F.concat(F.format_string("%d %s |", c("c_id"), c("last").cast("string")), F.coalesce(c("c_data"), F.lit("")))
    j = customers.join(per, "c_id")
    return j.select(
        "c_id",
        (c("c_balance") - c("paid")).alias("c_balance"),
        (c("c_ytd_payment") + c("paid")).alias("c_ytd_payment"),
        (c("c_payment_cnt") + c("n")).alias("c_payment_cnt"),
        F.when(c("c_credit") == "BC", F.substring(note, 1, most_data)).otherwise(c("c_data")).alias("c_data"),
    )


def delivered(open_orders: DataFrame, lines: DataFrame, *, district: str = "district") -> DataFrame:
    """The oldest open order of each district, with the amount (decimal) and number of its lines.

    There is one such order a district, so they are broadcast to the lines, which stay where they are.
    """
    oldest = open_orders.groupBy(district).agg(F.min_by("o_c_id", "o_id").alias("o_c_id"), F.min("o_id").alias("o_id"))
    sums = lines.join(F.broadcast(oldest.select("o_id")), c("ol_o_id") == c("o_id"), "left_semi").groupBy("ol_o_id").agg(F.sum("ol_amount").alias("amount"), F.count("*").alias("n_lines"))
    j = oldest.join(sums, c("o_id") == c("ol_o_id"), "left")
    return j.select(district, "o_id", "o_c_id", F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def delivery(open_orders: DataFrame, lines: DataFrame, *, district: str = "district") -> DataFrame:
    """The oldest open order of each district and the amount that its customer's balance grows by."""
    return delivered(open_orders, lines, district=district).withColumn("amount", c("amount").cast("double"))


def order_status(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Each customer's latest order with its lines summed up."""
    latest = orders.groupBy("o_c_id").agg(F.max("o_id").alias("o_id"))
    j = latest.join(lines, c("o_id") == c("ol_o_id"), "left")
    return j.groupBy("o_c_id", "o_id").agg(F.count("ol_o_id").alias("n_lines"), F.coalesce(F.sum("ol_amount"), F.lit(0)).cast("double").alias("amount"), F.max("ol_delivery_d").alias("last_delivery"))


def stock_level(orders: DataFrame, lines: DataFrame, stock: DataFrame, *, district: str = "district", last: int = 20, threshold: int = 20) -> DataFrame:
    """Per district: distinct stock rows below a threshold among the lines of its last orders."""
    rank = F.row_number().over(Window.partitionBy(district).orderBy(F.desc("o_id")))
    recent = orders.withColumn("rn", rank).where(c("rn") <= last).select(district, "o_id")
    low = stock.where(c("s_quantity") < threshold)
    j = lines.join(recent, c("ol_o_id") == c("o_id")).join(low, (c("ol_i_id") == c("s_i_id")) & (c("ol_su_key") == c("s_su_key")))
    return j.groupBy(district).agg(F.countDistinct("s_i_id", "s_su_key").alias("low_stock"))


# ---- change-log entries ----------------------------------------------------------------------------------


def entries(rows: DataFrame, base: DataFrame, *, key: str, epoch: int, op: str = "U") -> DataFrame:
    """Log entries for a table like ``base``: each row sets those of its columns that the table has (a D sets none)."""
    columns = [x for x in base.columns if x != key]
    set_ = [] if op == "D" else [x for x in columns if x in rows.columns]
    values = [(c(x) if x in set_ else F.lit(None)).cast(base.schema[x].dataType).alias(x) for x in columns]
    changed = F.array(*map(F.lit, set_)).cast("array<string>").alias("changed")
    return rows.select(F.lit(epoch).cast("long").alias("epoch"), F.lit(1).cast("long").alias("seq"), key, F.lit(op).alias("op"), changed, *values)


def new_order_entries(orders: DataFrame, lines: DataFrame, base: dict[str, DataFrame], epoch: int) -> dict[str, DataFrame]:
    """A batch of new orders: inserts of orders, new_order rows and lines; each district's counter and the stock move on.

    Orders have o_id, o_c_id, o_entry_d and o_d_id; they come without a carrier, their lines without a delivery date.
    """
    per = orders.groupBy(c("o_d_id").alias("d_id")).agg(F.count("*").alias("n"))
    counters = base["district"].join(per, "d_id").select("d_id", (c("d_next_o_id") + c("n")).alias("d_next_o_id"))
    moved = new_order_stock(lines, base["stock"].select("s_i_id", "s_su_key", "s_quantity"))
    old = base["stock"].select("s_id", "s_i_id", "s_su_key", c("s_ytd").alias("ytd"), c("s_order_cnt").alias("cnt"))
    stock = moved.join(old, ["s_i_id", "s_su_key"]).select("s_id", "s_quantity", (c("s_ytd") + c("ytd")).alias("s_ytd"), (c("s_order_cnt") + c("cnt")).alias("s_order_cnt"))
    return {
        "oorder": entries(orders.withColumn("o_carrier_id", F.lit(None)), base["oorder"], key="o_id", epoch=epoch, op="I"),
        "new_order": entries(orders.select("o_id", "o_d_id"), base["new_order"], key="o_id", epoch=epoch, op="I"),
        "order_line": entries(lines.withColumn("ol_delivery_d", F.lit(None)), base["order_line"], key="ol_o_id", epoch=epoch, op="I"),
        "district": entries(counters, base["district"], key="d_id", epoch=epoch),
        "stock": entries(stock, base["stock"], key="s_id", epoch=epoch),
    }


def payment_entries(payments: DataFrame, base: dict[str, DataFrame], epoch: int) -> dict[str, DataFrame]:
    """A batch of payments (seq, c_id, d_id, amount): customers, totals of districts and warehouses, and their history.

    The note of a history row is the warehouse's name, four spaces and the district's name.
    """
    per = payments.groupBy("d_id").agg(F.sum("amount").alias("paid"))  # a row a district
    districts = base["district"].join(per, "d_id")
    totals = districts.groupBy(c("d_w_id").alias("w_id")).agg(F.sum("paid").alias("paid"))
    names = base["district"].join(base["warehouse"], c("d_w_id") == c("w_id")).select("d_id", F.concat("w_name", F.lit("    "), "d_name").alias("h_data"))
    rows = payments.join(names, "d_id").select(c("seq").alias("h_id"), c("c_id").alias("h_c_id"), c("d_id").alias("h_d_id"), c("amount").alias("h_amount"), "h_data")
    return {
        "customer": entries(payment(base["customer"], payments), base["customer"], key="c_id", epoch=epoch),
        "district": entries(districts.select("d_id", (c("d_ytd") + c("paid")).alias("d_ytd")), base["district"], key="d_id", epoch=epoch),
        "warehouse": entries(base["warehouse"].join(totals, "w_id").select("w_id", (c("w_ytd") + c("paid")).alias("w_ytd")), base["warehouse"], key="w_id", epoch=epoch),
        "history": entries(rows, base["history"], key="h_id", epoch=epoch, op="I"),
    }


def delivery_entries(base: dict[str, DataFrame], epoch: int, *, carrier: int, day: Column) -> dict[str, DataFrame]:
    """One delivery in each district: its oldest new order goes, gets a carrier, its lines a date, its customer the amount."""
    open_ = base["oorder"].join(base["new_order"].select("o_id").hint("merge"), "o_id", "left_semi")  # planned alike at any size
    done = delivered(open_, base["order_line"], district="o_d_id")
    per = done.groupBy(c("o_c_id").alias("c_id")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    owing = base["customer"].join(per, "c_id").select("c_id", (c("c_balance") + c("amount")).alias("c_balance"), (c("c_delivery_cnt") + c("n")).alias("c_delivery_cnt"))
    lines = done.select(c("o_id").alias("ol_o_id"), day.alias("ol_delivery_d"))
    return {
        "new_order": entries(done, base["new_order"], key="o_id", epoch=epoch, op="D"),
        "oorder": entries(done.select("o_id", F.lit(carrier).alias("o_carrier_id")), base["oorder"], key="o_id", epoch=epoch),
        "order_line": entries(lines, base["order_line"], key="ol_o_id", epoch=epoch),
        "customer": entries(owing, base["customer"], key="c_id", epoch=epoch),
    }
