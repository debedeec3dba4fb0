"""The 22 analytical queries, as declared plans.

Joins are written without hints: dimension sides are small in the usual case but grow with the data, and Catalyst
and adaptive execution choose by size. Queries that need both an order's lines and the order group on the join key, so
that one shuffle serves both. Money is summed as decimals, which makes results independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.config import EngineConfig
from ledgerlake.sources import tables as t

c = F.col


def _money(x: Column) -> Column:
    return F.sum(x).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.round(a.cast("double") / b.cast("double"), 6)


def _nation_of_region(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    regions = t.region(spark, cfg.sf_dir).where(c("r_name").startswith(cfg["region_prefix"]))
    return t.nation(spark, cfg.sf_dir).join(regions, c("n_regionkey") == c("r_regionkey"), "left_semi")


def _lines_and_orders(spark: SparkSession, cfg: EngineConfig, *, delivered: bool = False) -> DataFrame:
    return t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=delivered).join(t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of), c("ol_o_id") == c("o_id"))


def q01(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Delivered lines summed up by line number."""
    n = F.count("*")
    return (
        t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True)
        .groupBy("ol_number")
        .agg(F.sum("ol_quantity").alias("sum_qty"), _money(c("ol_amount")).alias("sum_amount"), _ratio(F.sum("ol_quantity"), n).alias("avg_qty"), _ratio(F.sum("ol_amount"), n).alias("avg_amount"), n.alias("count_order"))
        .orderBy("ol_number")
    )


def q02(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Suppliers of a region that hold the least stock of an item, ties kept."""
    su = t.supplier(spark, cfg.sf_dir).join(_nation_of_region(spark, cfg), c("su_nationkey") == c("n_nationkey"))
    items = t.item(spark, cfg.sf_dir).where(c("i_data").endswith(cfg["item_suffix"]))
    held = t.stock(spark, cfg.sf_dir).join(items, c("s_i_id") == c("i_id")).join(su, c("s_su_key") == c("su_suppkey"))
    held = held.withColumn("least", F.min("s_quantity").over(Window.partitionBy("i_id"))).where(c("s_quantity") == c("least"))
    return held.select("su_suppkey", "su_name", "n_name", "i_id", "i_name", "s_quantity").orderBy("n_name", "su_name", "i_id")


def q03(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Open orders of customers in states that begin so, by revenue."""
    who = t.customer(spark, cfg.sf_dir).where(c("c_state").startswith(cfg["state_prefix"]))
    orders = t.new_order(spark, cfg.sf_dir, as_of=cfg.as_of).where(c("o_entry_d").isNotNull()).join(who, c("o_c_id") == c("c_id"), "left_semi")
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).join(orders, c("ol_o_id") == c("o_id"))
    return lines.groupBy("o_id", "o_entry_d").agg(_money(c("ol_amount")).alias("revenue")).orderBy(F.desc("revenue"), "o_entry_d", "o_id")


def _late(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Per order: its number of lines and how many were delivered on or after its entry."""
    late = F.count_if(c("ol_delivery_d") >= c("o_entry_d"))
    return _lines_and_orders(spark, cfg).where(c("o_entry_d").isNotNull()).groupBy("ol_o_id").agg(F.count("*").alias("o_ol_cnt"), late.alias("late"))


def q04(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Lines delivered on or after the order's entry, by the order's number of lines."""
    return _late(spark, cfg).groupBy("o_ol_cnt").agg(F.sum("late").alias("order_count")).where("order_count > 0").orderBy("o_ol_cnt")


def q04_exists(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Orders with such a line, by their number of lines."""
    return _late(spark, cfg).where("late > 0").groupBy("o_ol_cnt").agg(F.count("*").alias("order_count")).orderBy("o_ol_cnt")


def q05(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Revenue in a region where customer and supplier are of one nation."""
    su = t.supplier(spark, cfg.sf_dir).join(_nation_of_region(spark, cfg), c("su_nationkey") == c("n_nationkey"))
    cu = t.customer(spark, cfg.sf_dir).join(_nation_of_region(spark, cfg), c("c_nationkey") == c("n_nationkey"), "left_semi")
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).join(su, c("ol_su_key") == c("su_suppkey"))
    orders = t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of).join(cu.select("c_id", "c_nationkey"), c("o_c_id") == c("c_id"))
    j = lines.join(orders, (c("ol_o_id") == c("o_id")) & (c("c_nationkey") == c("su_nationkey")))
    return j.groupBy("n_name").agg(_money(c("ol_amount")).alias("revenue")).orderBy(F.desc("revenue"))


def q06(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Revenue of delivered lines of usual quantities."""
    return t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True).where(c("ol_quantity").between(1, 100_000)).agg(_money(c("ol_amount")).alias("revenue"))


def q07(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Revenue between two nations by year, both ways."""
    both = t.nation(spark, cfg.sf_dir).where(c("n_name").isin(cfg["nation"], cfg["other_nation"]))
    su = t.supplier(spark, cfg.sf_dir).join(both.select(c("n_nationkey").alias("su_nationkey"), c("n_name").alias("supp_nation")), "su_nationkey")
    cu = t.customer(spark, cfg.sf_dir).join(both.select(c("n_nationkey").alias("c_nationkey"), c("n_name").alias("cust_nation")), "c_nationkey")
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True).join(su, c("ol_su_key") == c("su_suppkey"))
    orders = t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of).join(cu, c("o_c_id") == c("c_id"))
    j = lines.join(orders, (c("ol_o_id") == c("o_id")) & (c("supp_nation") != c("cust_nation")))
    return j.groupBy("supp_nation", "cust_nation", F.year("o_entry_d").cast("long").alias("l_year")).agg(_money(c("ol_amount")).alias("revenue")).orderBy("supp_nation", "cust_nation", "l_year")


def q08(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """A nation's share of a region's revenue from some items, by year, and the revenue itself."""
    cu = t.customer(spark, cfg.sf_dir).join(_nation_of_region(spark, cfg), c("c_nationkey") == c("n_nationkey"), "left_semi")
    items = t.item(spark, cfg.sf_dir).where(c("i_data").endswith(cfg["item_suffix"]))
    su = t.supplier(spark, cfg.sf_dir).join(t.nation(spark, cfg.sf_dir).select(c("n_nationkey").alias("su_nationkey"), "n_name"), "su_nationkey")
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).join(items, c("ol_i_id") == c("i_id"), "left_semi").join(su, c("ol_su_key") == c("su_suppkey"))
    j = lines.join(t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of).join(cu, c("o_c_id") == c("c_id"), "left_semi"), c("ol_o_id") == c("o_id"))
    own = F.sum(F.when(c("n_name") == cfg["nation"], c("ol_amount")).otherwise(F.lit(0).cast(t.MONEY)))
    return j.groupBy(F.year("o_entry_d").cast("long").alias("l_year")).agg(own.cast("double").alias("nation_amount"), _ratio(own, F.sum("ol_amount")).alias("mkt_share")).orderBy("l_year")


def q09(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Revenue of some items by supplier nation and year."""
    items = t.item(spark, cfg.sf_dir).where(c("i_data").endswith(cfg["item_suffix_long"]))
    su = t.supplier(spark, cfg.sf_dir).join(t.nation(spark, cfg.sf_dir), c("su_nationkey") == c("n_nationkey"))
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).join(items, c("ol_i_id") == c("i_id"), "left_semi")
    j = lines.join(t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of), c("ol_o_id") == c("o_id")).join(su, c("ol_su_key") == c("su_suppkey"))
    return j.groupBy("n_name", F.year("o_entry_d").cast("long").alias("l_year")).agg(_money(c("ol_amount")).alias("sum_profit")).orderBy("n_name", F.desc("l_year"))


def q10(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Revenue of lines delivered on or after entry, by customer."""
    sums = _lines_and_orders(spark, cfg, delivered=True).where(c("o_entry_d") <= c("ol_delivery_d")).groupBy("o_c_id").agg(F.sum("ol_amount").alias("m"))
    cu = t.customer(spark, cfg.sf_dir).join(t.nation(spark, cfg.sf_dir), c("c_nationkey") == c("n_nationkey"))
    return sums.join(cu, c("o_c_id") == c("c_id")).select("c_id", "c_last", "c_state", "n_name", c("m").cast("double").alias("revenue")).orderBy(F.desc("revenue"), "c_id")


def q11(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Items that make up more than a share of what a nation's suppliers were ordered."""
    su = t.supplier(spark, cfg.sf_dir).join(t.nation(spark, cfg.sf_dir).where(c("n_name") == cfg["nation"]), c("su_nationkey") == c("n_nationkey"), "left_semi")
    per = t.stock(spark, cfg.sf_dir).join(su, c("s_su_key") == c("su_suppkey"), "left_semi").groupBy("s_i_id").agg(F.sum("s_order_cnt").alias("ordercount"))
    total = per.agg(F.sum("ordercount").alias("total"))  # one row
    return per.join(F.broadcast(total), c("ordercount") > c("total") * cfg["order_share"]).select("s_i_id", "ordercount").orderBy(F.desc("ordercount"), "s_i_id")


def q12(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Lines delivered on or after entry by the order's number of lines: carriers 1 and 2, and others."""
    on_time = c("o_entry_d") <= c("ol_delivery_d")
    high = c("o_carrier_id").isin(1, 2)
    per = _lines_and_orders(spark, cfg).groupBy("ol_o_id").agg(F.count("*").alias("o_ol_cnt"), F.count_if(on_time & high).alias("h"), F.count_if(on_time & ~high).alias("l"))
    return per.where("h + l > 0").groupBy("o_ol_cnt").agg(F.sum("h").alias("high_line_count"), F.sum("l").alias("low_line_count")).orderBy("o_ol_cnt")


def q13(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """How many customers have how many orders of some carriers; none counts as 0."""
    orders = t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of).where(c("o_carrier_id") > cfg["carrier_over"]).groupBy("o_c_id").agg(F.count("*").alias("n"))
    per = t.customer(spark, cfg.sf_dir).join(orders, c("c_id") == c("o_c_id"), "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("c_count"))
    return per.groupBy("c_count").agg(F.count("*").alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


def q14(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Share of promoted items in the revenue of delivered lines, in percent."""
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True).join(t.item(spark, cfg.sf_dir), c("ol_i_id") == c("i_id"))
    promo = F.sum(F.when(c("i_data").startswith(cfg["promo_prefix"]), c("ol_amount")).otherwise(F.lit(0).cast(t.MONEY)))
    return lines.agg(F.round(100.0 * promo.cast("double") / (1 + F.sum("ol_amount").cast("double")), 6).alias("promo_revenue"))


def q15(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Suppliers of the greatest delivered revenue, ties kept."""
    per = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True).groupBy("ol_su_key").agg(F.sum("ol_amount").alias("total"))
    best = per.agg(F.max("total").alias("best"))  # one row
    top = per.join(F.broadcast(best), c("total") == c("best"))
    return top.join(t.supplier(spark, cfg.sf_dir), c("ol_su_key") == c("su_suppkey")).select("su_suppkey", "su_name", c("total").cast("double").alias("total_revenue")).orderBy("su_suppkey")


def q16(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Suppliers in good standing by kind of item."""
    bad = t.supplier(spark, cfg.sf_dir).where(c("su_acctbal") < 0)
    items = t.item(spark, cfg.sf_dir).where(~c("i_data").startswith(cfg["excluded_prefix"]))
    j = t.stock(spark, cfg.sf_dir).join(bad, c("s_su_key") == c("su_suppkey"), "left_anti").join(items, c("s_i_id") == c("i_id"))
    by = j.groupBy("i_name", F.substring("i_data", 1, 3).alias("brand"), "i_price").agg(F.countDistinct("s_su_key").alias("supplier_cnt"))
    return by.orderBy(F.desc("supplier_cnt"), "i_name", "brand", "i_price")


def q17(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Half the revenue of lines below their item's average quantity, for some items."""
    items = t.item(spark, cfg.sf_dir).where(c("i_data").endswith(cfg["item_suffix"]))
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).join(items, c("ol_i_id") == c("i_id"), "left_semi")
    w = Window.partitionBy("ol_i_id")
    low = lines.withColumn("a", F.sum("ol_quantity").over(w) / F.count("*").over(w)).where(c("ol_quantity") < c("a"))
    return low.agg((F.coalesce(F.sum("ol_amount"), F.lit(0)).cast("double") / 2.0).alias("avg_yearly"))


def q18(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Large orders and their customers."""
    big = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).groupBy("ol_o_id").agg(F.sum("ol_amount").alias("m"), F.count("*").alias("o_ol_cnt")).where(c("m") > cfg["order_amount_over"])
    j = big.join(t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of), c("ol_o_id") == c("o_id")).join(t.customer(spark, cfg.sf_dir), c("o_c_id") == c("c_id"))
    return j.select("c_last", "c_id", "o_id", "o_entry_d", "o_ol_cnt", c("m").cast("double").alias("amount_sum")).orderBy(F.desc("amount_sum"), "o_entry_d", "o_id")


def q19(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Revenue under three alternative conditions on warehouse and item."""
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of).where(c("ol_quantity").between(1, 10) & c("ol_w_id").between(1, 5))
    j = lines.join(t.item(spark, cfg.sf_dir).where(c("i_price").between(1, 400_000)), c("ol_i_id") == c("i_id"))
    last = F.right("i_data", F.lit(1))
    any_of = (c("ol_w_id").isin(1, 2, 3) & (last == "t")) | (c("ol_w_id").isin(1, 2, 4) & (last == "g")) | (c("ol_w_id").isin(1, 5, 3) & (last == "r"))
    return j.where(any_of).agg(F.coalesce(F.sum("ol_amount"), F.lit(0)).cast("double").alias("revenue"))


def q20(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Suppliers with a surplus of some item: twice the stock exceeds all that was delivered."""
    items = t.item(spark, cfg.sf_dir).where(c("i_data").startswith(cfg["surplus_prefix"]))
    # the stock has a row for each (item, supplier) of the same lines, so that one grouping gives both sides
    sold = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True).join(items, c("ol_i_id") == c("i_id"), "left_semi").groupBy("ol_i_id", "ol_su_key").agg(F.sum("ol_quantity").alias("q"))
    j = sold.where(2 * t.stock_quantity(c("ol_i_id"), c("ol_su_key")) > c("q")).select(c("ol_su_key").alias("s_su_key"))
    su = t.supplier(spark, cfg.sf_dir).join(t.nation(spark, cfg.sf_dir), c("su_nationkey") == c("n_nationkey"))
    return su.join(j, c("su_suppkey") == c("s_su_key"), "left_semi").select("su_suppkey", "su_name", "n_name").orderBy("su_name")


def q21(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Suppliers of a nation who kept orders waiting: no line of the order was delivered later than theirs."""
    last = F.max("ol_delivery_d").over(Window.partitionBy("ol_o_id"))
    lines = t.order_line(spark, cfg.sf_dir, as_of=cfg.as_of, delivered=True).select("ol_o_id", "ol_su_key", "ol_delivery_d", last.alias("last")).where(c("ol_delivery_d") == c("last"))
    su = t.supplier(spark, cfg.sf_dir).join(t.nation(spark, cfg.sf_dir).where(c("n_name") == cfg["nation"]), c("su_nationkey") == c("n_nationkey"), "left_semi")
    j = lines.join(t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of), (c("ol_o_id") == c("o_id")) & (c("ol_delivery_d") >= c("o_entry_d"))).join(su, c("ol_su_key") == c("su_suppkey"))
    return j.groupBy("su_name").agg(F.count("*").alias("numwait")).orderBy(F.desc("numwait"), "su_name")


def q22(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Customers of above-average balance without an order since a date, by first letter of the state."""
    cu = t.customer(spark, cfg.sf_dir).where(c("c_phone0").between(1, 7) & (c("c_balance") > cfg["balance_over"]))
    mean = cu.agg((F.sum("c_balance").cast("double") / F.count("*")).alias("mean"))  # one row
    recent = t.oorder(spark, cfg.sf_dir, as_of=cfg.as_of).where(c("o_entry_d") >= F.to_timestamp_ntz(F.lit(cfg["idle_since"])))
    idle = cu.join(F.broadcast(mean), c("c_balance").cast("double") >= c("mean")).join(recent, c("c_id") == c("o_c_id"), "left_anti")
    return idle.groupBy(F.substring("c_state", 1, 1).alias("country")).agg(F.count("*").alias("numcust"), _money(c("c_balance")).alias("totacctbal")).orderBy("country")


SQL = {
    "q01": """SELECT ol_number, sum(ol_quantity) AS sum_qty, CAST(sum(ol_amount) AS DOUBLE) AS sum_amount, round(sum(ol_quantity) / count(*), 6) AS avg_qty,
        round(CAST(sum(ol_amount) AS DOUBLE) / count(*), 6) AS avg_amount, count(*) AS count_order FROM order_line WHERE ol_delivery_d IS NOT NULL GROUP BY ol_number""",
    "q02": """WITH h AS (SELECT su_suppkey, su_name, n_name, i_id, i_name, s_quantity FROM stock JOIN item ON s_i_id = i_id JOIN supp ON s_su_key = su_suppkey JOIN nation ON su_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'EUROP%' AND i_data LIKE '%t') SELECT * FROM h WHERE s_quantity = (SELECT min(x.s_quantity) FROM h x WHERE x.i_id = h.i_id)""",
    "q03": """SELECT o_id, o_entry_d, CAST(sum(ol_amount) AS DOUBLE) AS revenue FROM oorder JOIN order_line ON ol_o_id = o_id JOIN cust ON o_c_id = c_id WHERE o_status = 'O' AND c_state LIKE 'A%' GROUP BY o_id, o_entry_d""",
    "q04": """WITH n AS (SELECT ol_o_id AS k, count(*) AS o_ol_cnt FROM order_line GROUP BY 1) SELECT o_ol_cnt, count(*) AS order_count FROM order_line JOIN oorder ON ol_o_id = o_id JOIN n ON k = o_id WHERE ol_delivery_d >= o_entry_d GROUP BY 1""",
    "q04_exists": """WITH n AS (SELECT ol_o_id AS k, count(*) AS o_ol_cnt FROM order_line GROUP BY 1) SELECT o_ol_cnt, count(*) AS order_count FROM oorder JOIN n ON k = o_id
        WHERE EXISTS (SELECT 1 FROM order_line WHERE ol_o_id = o_id AND ol_delivery_d >= o_entry_d) GROUP BY 1""",
    "q05": """SELECT n_name, CAST(sum(ol_amount) AS DOUBLE) AS revenue FROM order_line JOIN oorder ON ol_o_id = o_id JOIN cust ON o_c_id = c_id JOIN supp ON ol_su_key = su_suppkey JOIN nation ON su_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = su_nationkey AND r_name LIKE 'EUROP%' GROUP BY 1""",
    "q06": """SELECT CAST(sum(ol_amount) AS DOUBLE) AS revenue FROM order_line WHERE ol_delivery_d IS NOT NULL AND ol_quantity BETWEEN 1 AND 100000""",
    "q07": """SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(o_entry_d) AS BIGINT) AS l_year, CAST(sum(ol_amount) AS DOUBLE) AS revenue FROM order_line JOIN oorder ON ol_o_id = o_id JOIN cust ON o_c_id = c_id
        JOIN supp ON ol_su_key = su_suppkey JOIN nation a ON su_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
        WHERE ol_delivery_d IS NOT NULL AND ((a.n_name = 'NATION_3' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_3')) GROUP BY 1, 2, 3""",
    "q08": """SELECT CAST(year(o_entry_d) AS BIGINT) AS l_year, CAST(sum(CASE WHEN b.n_name = 'NATION_3' THEN ol_amount ELSE 0 END) AS DOUBLE) AS nation_amount,
        round(CAST(sum(CASE WHEN b.n_name = 'NATION_3' THEN ol_amount ELSE 0 END) AS DOUBLE) / CAST(sum(ol_amount) AS DOUBLE), 6) AS mkt_share
        FROM order_line JOIN oorder ON ol_o_id = o_id JOIN cust ON o_c_id = c_id JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey JOIN item ON ol_i_id = i_id
        JOIN supp ON ol_su_key = su_suppkey JOIN nation b ON su_nationkey = b.n_nationkey WHERE r_name LIKE 'EUROP%' AND i_data LIKE '%t' GROUP BY 1""",
    "q09": """SELECT n_name, CAST(year(o_entry_d) AS BIGINT) AS l_year, CAST(sum(ol_amount) AS DOUBLE) AS sum_profit FROM order_line JOIN oorder ON ol_o_id = o_id JOIN item ON ol_i_id = i_id
        JOIN supp ON ol_su_key = su_suppkey JOIN nation ON su_nationkey = n_nationkey WHERE i_data LIKE '%lt' GROUP BY 1, 2""",
    "q10": """SELECT c_id, c_last, c_state, n_name, CAST(sum(ol_amount) AS DOUBLE) AS revenue FROM order_line JOIN oorder ON ol_o_id = o_id JOIN cust ON o_c_id = c_id JOIN nation ON c_nationkey = n_nationkey
        WHERE o_entry_d <= ol_delivery_d GROUP BY 1, 2, 3, 4""",
    "q11": """WITH p AS (SELECT s_i_id, CAST(sum(s_order_cnt) AS BIGINT) AS ordercount FROM stock JOIN supp ON s_su_key = su_suppkey JOIN nation ON su_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY 1)
        SELECT * FROM p WHERE ordercount > (SELECT sum(ordercount) FROM p) * CAST(0.001 AS DOUBLE)""",
    "q12": """WITH n AS (SELECT ol_o_id AS k, count(*) AS o_ol_cnt FROM order_line GROUP BY 1) SELECT o_ol_cnt, CAST(sum(CASE WHEN o_carrier_id IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_carrier_id IN (1, 2) THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count FROM order_line JOIN oorder ON ol_o_id = o_id JOIN n ON k = o_id WHERE o_entry_d <= ol_delivery_d GROUP BY 1""",
    "q13": """WITH p AS (SELECT c_id, count(o_id) AS c_count FROM cust LEFT JOIN oorder ON o_c_id = c_id AND o_carrier_id > 3 GROUP BY 1) SELECT c_count, count(*) AS custdist FROM p GROUP BY 1""",
    "q14": """SELECT round(100.0 * CAST(sum(CASE WHEN i_data LIKE 'PR%' THEN ol_amount ELSE 0 END) AS DOUBLE) / (1 + CAST(sum(ol_amount) AS DOUBLE)), 6) AS promo_revenue
        FROM order_line JOIN item ON ol_i_id = i_id WHERE ol_delivery_d IS NOT NULL""",
    "q15": """WITH p AS (SELECT ol_su_key, sum(ol_amount) AS m FROM order_line WHERE ol_delivery_d IS NOT NULL GROUP BY 1)
        SELECT su_suppkey, su_name, CAST(m AS DOUBLE) AS total_revenue FROM p JOIN supp ON ol_su_key = su_suppkey WHERE m = (SELECT max(m) FROM p)""",
    "q16": """SELECT i_name, substr(i_data, 1, 3) AS brand, i_price, count(DISTINCT s_su_key) AS supplier_cnt FROM stock JOIN item ON s_i_id = i_id
        WHERE i_data NOT LIKE 'ST%' AND s_su_key NOT IN (SELECT su_suppkey FROM supp WHERE su_acctbal < 0) GROUP BY 1, 2, 3""",
    "q17": """WITH l AS (SELECT ol_i_id, ol_quantity, ol_amount FROM order_line JOIN item ON ol_i_id = i_id WHERE i_data LIKE '%t'), a AS (SELECT ol_i_id AS k, avg(ol_quantity) AS a FROM l GROUP BY 1)
        SELECT CAST(coalesce(sum(ol_amount), 0) AS DOUBLE) / 2.0 AS avg_yearly FROM l JOIN a ON k = ol_i_id WHERE ol_quantity < a""",
    "q18": """SELECT c_last, c_id, o_id, o_entry_d, count(*) AS o_ol_cnt, CAST(sum(ol_amount) AS DOUBLE) AS amount_sum FROM order_line JOIN oorder ON ol_o_id = o_id JOIN cust ON o_c_id = c_id
        GROUP BY 1, 2, 3, 4 HAVING sum(ol_amount) > 200000""",
    "q19": """SELECT CAST(coalesce(sum(ol_amount), 0) AS DOUBLE) AS revenue FROM order_line JOIN item ON ol_i_id = i_id WHERE ol_quantity BETWEEN 1 AND 10 AND i_price BETWEEN 1 AND 400000
        AND ((ol_w_id IN (1, 2, 3) AND i_data LIKE '%t') OR (ol_w_id IN (1, 2, 4) AND i_data LIKE '%g') OR (ol_w_id IN (1, 5, 3) AND i_data LIKE '%r'))""",
    "q20": """WITH s AS (SELECT ol_i_id, ol_su_key, sum(ol_quantity) AS q FROM order_line JOIN item ON ol_i_id = i_id WHERE i_data LIKE 'EC%' AND ol_delivery_d IS NOT NULL GROUP BY 1, 2)
        SELECT su_suppkey, su_name, n_name FROM supp JOIN nation ON su_nationkey = n_nationkey
        WHERE su_suppkey IN (SELECT ol_su_key FROM s JOIN stock ON ol_i_id = s_i_id AND ol_su_key = s_su_key WHERE 2 * s_quantity > q)""",
    "q21": """SELECT su_name, count(*) AS numwait FROM order_line a JOIN oorder ON a.ol_o_id = o_id JOIN supp ON a.ol_su_key = su_suppkey JOIN nation ON su_nationkey = n_nationkey WHERE n_name = 'NATION_3'
        AND a.ol_delivery_d >= o_entry_d AND NOT EXISTS (SELECT 1 FROM order_line b WHERE b.ol_o_id = a.ol_o_id AND b.ol_delivery_d > a.ol_delivery_d) GROUP BY 1""",
    "q22": """WITH p AS (SELECT * FROM cust WHERE c_phone0 BETWEEN 1 AND 7 AND c_balance > -20)
        SELECT substr(c_state, 1, 1) AS country, count(*) AS numcust, CAST(sum(c_balance) AS DOUBLE) AS totacctbal FROM p WHERE CAST(c_balance AS DOUBLE) >= (SELECT CAST(sum(c_balance) AS DOUBLE) / count(*) FROM p)
        AND NOT EXISTS (SELECT 1 FROM oorder WHERE o_c_id = c_id AND o_entry_d >= TIMESTAMP '2001-01-01') GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
