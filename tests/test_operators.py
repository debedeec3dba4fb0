"""Keys, snapshots, link joins, transactions and the stream on small hand-made tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.config import EngineConfig
from ledgerlake.functions import generators, keys
from ledgerlake.operators import invariants, linkjoin, snapshots, transactions
from ledgerlake.plans import analytics, versioned
from ledgerlake.sources import generator, tables
from ledgerlake.streaming.epochs import EpochPipeline, freshness, report

COLUMNS = ("a", "b")
LOG = "epoch long, seq long, k long, op string, changed array<string>, a long, b string"


def test_key_round_trips(spark):
    df = spark.range(2000).select((F.col("id") % 7 + 1).alias("w"), (F.col("id") % 10 + 1).alias("d"), (F.col("id") * 37 % 9_999 + 1).alias("o"), (F.col("id") % 15 + 1).alias("n"))
    k = keys.order_line_key(F.col("w"), F.col("d"), F.col("o"), F.col("n"))
    o = keys.order_key(F.col("w"), F.col("d"), F.col("o"))
    dk = keys.upper_to_district_key(o)
    bad = df.where((keys.order_line_key_to_order_key(k) != o) | (keys.order_line_key_to_number(k) != F.col("n")) | (keys.lower_part(o) != F.col("o")) | (keys.district_key_to_warehouse(dk) != F.col("w")) | (keys.district_key_to_district(dk) != F.col("d")))
    assert bad.count() == 0
    s = keys.stock_key(F.col("w"), F.col("o"))
    assert df.where((keys.stock_key_to_warehouse(s) != F.col("w")) | (keys.stock_key_to_item(s) != F.col("o"))).count() == 0


def test_keys_of_more_items_and_orders_than_a_key_leaves_room_for(spark):
    df = spark.createDataFrame([(w, d, o, n, i) for w in (1, 7, 10) for d in (1, 10) for o in (9_999_999, 10_000_000, 54_000_001) for n in (1, 7, 15) for i in (99_999, 100_000, 100_001, 1_200_001)], "w long, d long, o long, n long, i long")
    dk, ok = keys.district_key(F.col("w"), F.col("d")), keys.order_key(F.col("w"), F.col("d"), F.col("o"))
    lk, sk = keys.order_line_key(F.col("w"), F.col("d"), F.col("o"), F.col("n")), keys.stock_key(F.col("w"), F.col("i"))
    assert df.where((keys.order_line_key_to_order_key(lk, dk) != ok) | (keys.order_line_key_to_number(lk) != F.col("n")) | (keys.stock_key_to_item(sk, F.col("w")) != F.col("i"))).count() == 0
    far = spark.createDataFrame([((1 << 53) * 10 + 7,)], "w long").select(keys.district_key(F.col("w"), F.lit(10)).alias("k"), "w")  # no double holds it
    assert far.where(keys.district_key_to_warehouse(F.col("k")) != F.col("w")).count() == 0


def test_key_codecs_query_on_large_numbers(spark, tmp_path):
    import duckdb

    from ledgerlake import registry

    rows = [(o, p, s, n) for o in (5, 12_345_678) for p in (3, 99_998, 99_999, 100_000, 123_456) for s in (9, 60_000) for n in (1, 7)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame([(*r, 1.0, 2.0, "O", None) for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["key_codecs"]).to_arrow_table()
    got = registry.QUERIES["key_codecs"](spark, str(tmp_path)).toArrow()
    told = lambda t: sorted(tuple(r[x] for x in sorted(want.column_names)) for r in t.to_pylist())
    assert told(got) == told(want) and len(told(want)) == len(rows)


def test_customer_history_and_order_index_keys_round_trip(spark):
    df = spark.range(6000).select((F.col("id") % 7 + 1).alias("w"), (F.col("id") % 10 + 1).alias("d"), (F.col("id") * 37 % 3_000 + 1).alias("c"), (F.col("id") * 41 % 9_999 + 1).alias("o"), (F.col("id") % 3 + 1).alias("pw"), (F.col("id") * 3 % 10 + 1).alias("pd"))
    ck = keys.customer_key(F.col("w"), F.col("d"), F.col("c"))
    ik = keys.order_index_key(F.col("w"), F.col("d"), F.col("c"), F.col("o"))
    hk = keys.history_key(F.col("w"), F.col("d"), F.col("c"), F.col("pd"), F.col("pw"))
    dk = keys.upper_to_district_key(ck)
    same = (keys.customer_key_to_customer(ck) == F.col("c")) & (keys.district_key_to_warehouse(dk) == F.col("w")) & (keys.district_key_to_district(dk) == F.col("d"))
    same &= (keys.order_index_key_to_customer_key(ik) == ck) & (keys.lower_part(ik) == F.col("o"))
    same &= (keys.history_key_to_customer_key(hk) == ck) & (keys.history_key_to_district_key(hk) == keys.district_key(F.col("pw"), F.col("pd")))
    assert df.where(~same).count() == 0


def test_snapshot_keeps_untouched_columns_and_explicit_nulls(spark):
    base = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "k long, a long, b string")
    log = spark.createDataFrame([(1, 1, 1, "U", ["a"], 11, None), (2, 1, 1, "U", ["b"], None, None), (3, 1, 2, "D", [], None, None), (2, 5, 3, "I", ["a", "b"], 30, "z")], LOG)
    at = lambda v, **m: {r.k: (r.a, r.b) for r in snapshots.as_of(base, log, v, key="k", columns=COLUMNS, **m).collect()}
    assert at(0) == {1: (10, "x"), 2: (20, "y")}
    assert at(1) == {1: (11, "x"), 2: (20, "y")}
    assert at(2) == {1: (11, None), 2: (20, "y"), 3: (30, "z")}
    assert at(3) == {1: (11, None), 3: (30, "z")} == at(None)
    assert at(3, apply_deletes=False)[2] == (20, "y")


def test_compaction_changes_no_later_snapshot(spark):
    base = spark.range(5).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("a"), F.lit("b").alias("b"))
    rows = [(e, s, (e * 3 + s) % 7, "D" if (e + s) % 5 == 0 else "U", [["a"], ["b"], ["a", "b"]][(e + s) % 3], e * 10 + s, f"{e}-{s}") for e in range(1, 9) for s in range(1, 4)]
    log = spark.createDataFrame(rows, LOG)
    short = snapshots.compact(log, 4, key="k", columns=COLUMNS)
    for v in (4, 6, 8):
        one, two = (sorted(map(tuple, snapshots.as_of(base, x, v, key="k", columns=COLUMNS).collect())) for x in (log, short))
        assert one == two
    assert short.count() < log.count()
    again = log.unionByName(log)  # replays do no harm
    assert sorted(map(tuple, snapshots.as_of(base, again, 8, key="k", columns=COLUMNS).collect())) == sorted(map(tuple, snapshots.as_of(base, log, 8, key="k", columns=COLUMNS).collect()))


def test_link_join_plans_agree(spark, sf):
    orders, lines = tables.oorder(spark, sf), tables.order_line(spark, sf)
    stored = linkjoin.nest(orders, lines)
    assert stored.count() == orders.count()
    assert len({tuple(x.first()) for x in (linkjoin.nested(stored), linkjoin.by_key(orders, lines), linkjoin.by_range(orders, lines))}) == 1


def test_stock_rule(spark):
    got = spark.createDataFrame([(50, 5), (14, 5), (15, 5)], "q long, o long").select(transactions.stock_after(F.col("q"), F.col("o")).alias("r"))
    assert [r.r for r in got.collect()] == [45, 100, 10]


def test_stock_of_a_batch_is_its_steps_one_by_one(spark):
    rows = [(i, 1, 10 + (i * 17) % 91, [(i * 7 + j * 13) % 92 for j in range(i % 12)]) for i in range(200)]
    stock = spark.createDataFrame([(i, w, q) for i, w, q, _ in rows], "s_i_id long, s_su_key long, s_quantity long")
    lines = spark.createDataFrame([(i, w, x) for i, w, _, xs in rows for x in xs], "ol_i_id long, ol_su_key long, ol_quantity long")
    want = {}
    for i, _, q, xs in rows:
        for x in xs:
            q = q - x if q - x >= 10 else q - x + 91
        if xs:
            want[i] = (q, sum(xs), len(xs))
    assert {r.s_i_id: (r.s_quantity, r.s_ytd, r.s_order_cnt) for r in transactions.new_order_stock(lines, stock).collect()} == want
    with pytest.raises(Exception, match="stock of 10 to 100"):
        transactions.new_order_stock(spark.createDataFrame([(1, 1, 92)], lines.schema), stock).collect()


def test_a_snapshot_moved_on_by_batches_is_the_snapshot_of_the_log(spark):
    base = spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (4, 40, "z")], "k long, a long, b string")
    log = spark.createDataFrame([(1, 1, 1, "U", ["a"], 11, None), (1, 1, 5, "I", ["a", "b"], 50, "n"), (2, 1, 1, "U", ["b"], None, None), (2, 1, 5, "U", ["a"], 51, None), (3, 1, 2, "D", [], None, None), (3, 1, 4, "U", ["a", "b"], None, "w")], LOG)
    for few in (False, True):
        now = base
        for epoch in (1, 2, 3):
            now = snapshots.moved_on(now, log.where(F.col("epoch") == epoch), key="k", columns=COLUMNS, few=few)
            assert sorted(map(tuple, now.collect())) == sorted(map(tuple, snapshots.as_of(base, log, epoch, key="k", columns=COLUMNS).collect()))


def test_equal_lines_stay_apart_and_lines_move_once(spark, sf, tmp_path):
    import contextlib
    import io

    d = dt.datetime
    cfg = _fixture(
        spark, tmp_path,
        customer=spark.createDataFrame([(1, "C1", 3, 100.0, "AUTO"), (2, "C2", 7, 300.0, "BUILD")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        orders=spark.createDataFrame([(1, 1, "O", 1.0, d(1999, 1, 1), "4-LOW"), (2, 1, "O", 1.0, d(1999, 1, 1), "4-LOW"), (3, 2, "F", 1.0, d(2001, 2, 1), "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        lineitem=spark.createDataFrame([(o, 1, 1, 1, 5.0, 10.0, "F", d(1999, 1, 5)) for o in (1, 1, 2, 2, 2, 3, 3)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz"),
    )
    got = {r.ol_o_id: (r.n_lines, r.n_delivered, r.last_delivery) for r in versioned.ledger_lines(spark, cfg).collect()}
    assert got == {1: (2, 2, d(2002, 1, 1)), 2: (3, 0, None), 3: (2, 2, d(1999, 1, 5))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            versioned.ledger_lines(spark, EngineConfig(sf)).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", out.getvalue())
    assert any("ol_o_id" in x for x in moved) and not any(y in x for x in moved for y in ("line_id", "number", "ol_i_id", "quantity", "shipped"))  # not whole lines


def test_entries_name_what_they_set(spark):
    base = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "k long, a long, b string")
    rows = spark.createDataFrame([(2, 21, True)], "k int, a int, other boolean")
    log = transactions.entries(rows, base, key="k", epoch=3).unionByName(transactions.entries(rows.selectExpr("1 as k"), base, key="k", epoch=4, op="D"))
    assert [tuple(r.changed) for r in log.orderBy("epoch").collect()] == [("a",), ()] and [f.dataType for f in log.schema if f.name in COLUMNS] == [base.schema[x].dataType for x in COLUMNS]
    at = lambda e: sorted(map(tuple, snapshots.as_of(base, log, e, key="k", columns=COLUMNS).collect()))
    assert at(2) == [(1, 10, "x"), (2, 20, "y")] and at(3) == [(1, 10, "x"), (2, 21, "y")] and at(4) == [(2, 21, "y")]


def test_generated_tables_hold_their_invariants(spark):
    for name, df in (("warehouse", generator.warehouse(spark, 2)), ("district", generator.district(spark, 1)), ("customer", generator.customer(spark, 1)), ("oorder", generator.oorder(spark, 1)), ("order_line", generator.order_line(spark, 1).where("ol_d_id = 1")), ("item", generator.item(spark, 500)), ("stock", generator.stock(spark, 1, 500))):
        found = invariants.violations(df, name).first().asDict()
        assert found.pop("rows") > 0 and not any(found.values()), (name, found)
    per = generator.oorder(spark, 1).groupBy("o_d_id").agg(F.countDistinct("o_c_id").alias("n"))
    assert {r.n for r in per.collect()} == {3000}
    assert generator.new_order(spark, 1).count() == 9000 and generator.nation(spark).count() == 62 and generator.region(spark).count() == 5
    assert generator.supplier(spark).where(~F.col("su_name").rlike("^Supplier#[0-9]{9}$")).count() == 0
    assert generator.history(spark, 1).count() == 30_000
    assert spark.range(1).select(generators.last_name(F.lit(371))).first()[0] == "PRICALLYOUGHT"


def _fixture(spark, path, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return EngineConfig(str(path))


def test_query_semantics_on_hand_made_rows(spark, tmp_path):
    d = dt.datetime
    cfg = _fixture(
        spark, tmp_path,
        region=spark.createDataFrame([(3, "EUROPE")], "r_regionkey int, r_name string"),
        nation=spark.createDataFrame([(3, "NATION_3", 3), (7, "NATION_7", 3)], "n_nationkey int, n_name string, n_regionkey int"),
        supplier=spark.createDataFrame([(1, "S1", 3, 5.0), (2, "S2", 7, 5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        customer=spark.createDataFrame([(1, "C1", 3, 100.0, "AUTO"), (2, "C2", 7, 300.0, "BUILD"), (3, "C3", 7, 300.0, "BUILD")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        part=spark.createDataFrame([(1, "small bolt", "B", "PROMO", 1, 9.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        orders=spark.createDataFrame([(1, 1, "O", 1.0, d(1999, 1, 1), "4-LOW"), (2, 2, "F", 1.0, d(2001, 2, 1), "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        lineitem=spark.createDataFrame([(1, 1, 1, 1, 5.0, 10.0, "F", d(1999, 1, 5)), (1, 1, 2, 2, 7.0, 20.0, "O", d(1999, 9, 9)), (2, 1, 2, 1, 9.0, 30.0, "F", d(2001, 3, 1))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz"),
    )
    rows = lambda q: [tuple(r) for r in q(spark, cfg).collect()]
    least = rows(analytics.q02)
    assert [(r[0], r[5]) for r in least] == [(1, 30)]  # the minimum of 30 and 43
    assert (0, 1) not in [r[:1] for r in rows(analytics.q13)] and sorted(rows(analytics.q13)) == [(0, 2), (1, 1)]
    assert rows(analytics.q15) == [(2, "S2", 30.0)]
    assert rows(analytics.q21) == [("S1", 1)]  # an undelivered later line doesn't count
    assert rows(analytics.q22) == [("B", 1, 300.0)]  # customer 2 has a recent order
    assert rows(analytics.q07) == []
    one = rows(analytics.q20)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert rows(analytics.q20) == one
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_epochs_clamp_late_entries_and_commit_once(spark, tmp_path):
    pipe = EpochPipeline(spark, str(tmp_path / "p"))
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batch = lambda *r: spark.createDataFrame(list(r), "epoch long, ts timestamp_ntz, v long")
    pipe.commit(batch((1, at(1), 1), (2, at(2), 2)), 0)
    pipe.commit(batch((1, at(1), 3), (5, at(5), 4)), 1)
    pipe.commit(batch((1, at(1), 3), (5, at(5), 4)), 1)  # tried again
    got = sorted(tuple(r) for r in pipe.log("epoch long, ts timestamp_ntz, v long").select("epoch", "v").collect())
    assert got == [(1, 1), (2, 2), (3, 3), (5, 4)] and pipe.read_epoch() == 5 and pipe.read_epoch(1) == 2


def test_stream_reads_files_in_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), i)], "epoch long, ts timestamp_ntz, v long").write.mode("append").parquet(str(tmp_path / "in"))
    pipe = EpochPipeline(spark, str(tmp_path / "p"))
    stream = spark.readStream.schema("epoch long, ts timestamp_ntz, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = pipe.start(stream)
    query.awaitTermination()
    told = report(query)
    assert told["batches"] == 3 and told["entries"] == 3 and told["per_second"] > 0
    log = pipe.log("epoch long, ts timestamp_ntz, v long")
    assert log.agg(F.sum("v")).first()[0] == 3 and pipe.marks().count() >= 3
    assert freshness(log, 3600).first().epochs >= 1


def test_held_epochs_are_readable_once_a_later_one_was_seen(spark, tmp_path):
    pipe = EpochPipeline(spark, str(tmp_path / "p"), hold=1)
    batch = lambda *r: spark.createDataFrame([(e, dt.datetime(2024, 1, 1, e), v) for e, v in r], "epoch long, ts timestamp_ntz, v long")
    pipe.commit(batch((1, 1), (2, 2)), 0)
    assert pipe.read_epoch() == 1
    pipe.commit(batch((1, 3), (2, 4), (5, 5)), 1)
    assert pipe.read_epoch() == 4
    pipe.finish()
    pipe.finish()  # tried again
    got = sorted(tuple(r) for r in pipe.log("epoch long, ts timestamp_ntz, v long, own_epoch long").select("own_epoch", "epoch", "v").collect())
    assert got == [(1, 1, 1), (1, 2, 3), (2, 2, 2), (2, 2, 4), (5, 5, 5)] and pipe.read_epoch() == 5 and pipe.read_epoch(1) == 1


def test_stream_epochs_do_not_depend_on_the_number_of_files(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for hours in ([3, 9, 30], [4, 10], [8, 40], [1, 31], [2, 9, 41], [5, 7, 29], [0, 50]):  # epochs of six hours, out of order
        rows = [(h, start + dt.timedelta(hours=h), 1, "x", 1.5 * h, "{}") for h in hours]
        spark.createDataFrame(rows, versioned.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.epoch: (r.n, r.total) for r in versioned.stream_epochs(spark, EngineConfig(str(tmp_path))).collect()}
    want: dict = {}
    for h in [3, 9, 30, 4, 10, 8, 40, 1, 31, 2, 9, 41, 5, 7, 29, 0, 50]:
        e = int((start - dt.datetime(1970, 1, 1)).total_seconds() // 21600) + h // 6
        n, total = want.get(e, (0, 0.0))
        want[e] = (n + 1, total + 1.5 * h)
    assert got == want


def test_staleness_is_measured_against_the_clock(spark, tmp_path):
    pipe = EpochPipeline(spark, str(tmp_path / "p"), hold=1)
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)  # the session's zone is UTC
    schema = "epoch long, ts timestamp_ntz, v long"
    pipe.commit(spark.createDataFrame([(1, now - dt.timedelta(hours=2), 1), (2, now, 2)], schema), 0)
    assert 7200 <= pipe.staleness(schema).first()[0] < 7500  # epoch 2 can't be read yet
    pipe.finish()
    assert 0 <= pipe.staleness(schema).first()[0] < 300


def test_index_answers_after_puts_and_a_put_done_again(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 500).alias("k"), F.col("id").alias("v"))
    at = str(tmp_path / "index")
    tables.build_index(rows.where("v < 600"), at, "k")
    for _ in range(2):
        tables.put_index(rows.where("v >= 600"), at, "k", 1)
    got = tables.read_index(spark, at).where("k between 10 and 12")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where("k between 10 and 12").collect()))
    assert "GreaterThanOrEqual(k,10)" in got._jdf.queryExecution().toString()


def test_config_overrides_defaults():
    cfg = EngineConfig("x", params={"nation": "N"})
    assert cfg["nation"] == "N" and cfg["carrier_over"] == 3
    with pytest.raises(KeyError):
        cfg["nothing"]


def test_read_epoch_is_the_least_over_channels_and_early_entries_are_held(spark, tmp_path):
    pipe = EpochPipeline(spark, str(tmp_path / "p"), channels=("a", "b"))
    schema = "epoch long, channel string, ts timestamp_ntz, v long"
    batch = lambda *rows: spark.createDataFrame([(e, ch, None, v) for e, ch, v in rows], schema)
    seen = lambda: sorted((r.epoch, r.own_epoch, r.v) for r in pipe.readable(schema + ", own_epoch long").collect())
    pipe.commit(batch((1, "a", 10), (9, "a", 11)), 0)
    assert pipe.read_epoch() == -1 and seen() == []  # b has sent nothing
    pipe.commit(batch((1, "b", 20), (3, "b", 21)), 1)
    assert pipe.read_epoch() == 3 and seen() == [(1, 1, 10), (1, 1, 20), (3, 3, 21)]  # 9 came early
    pipe.commit(batch((2, "a", 12), (5, "b", 22), (4, None, 30)), 2)
    pipe.commit(batch((2, "a", 12), (5, "b", 22), (4, None, 30)), 2)  # tried again
    assert pipe.read_epoch() == 5 and seen() == [(1, 1, 10), (1, 1, 20), (3, 3, 21), (4, 2, 12), (4, 4, 30), (5, 5, 22)]  # 2 came late
    pipe.commit(batch((12, "b", 23)), 3)
    assert pipe.read_epoch() == 9 and (9, 9, 11) in seen() and (12, 12, 23) not in seen()
    pipe.finish()
    assert pipe.read_epoch() == 12 and len(seen()) == 8


def test_a_query_at_an_epoch_reads_the_logs(spark, sf):
    from ledgerlake.plans import analytics

    sums = [analytics.q06(spark, EngineConfig(sf, as_of=e)).first().revenue or 0 for e in (0, 10, 20, 99)]
    assert sums[0] == 0 < sums[1] < sums[2] < sums[3] == analytics.q06(spark, EngineConfig(sf)).first().revenue
    assert analytics.q18(spark, EngineConfig(sf, as_of=0)).count() == 0
