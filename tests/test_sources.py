import struct

import pytest

from pyspark.sql import functions as F

from tidemark.sources import readers, wire
from tidemark.sources.synthetic import synthetic_bars, synthetic_trades


@pytest.mark.parametrize("layout,size", [(wire.TARGET, 28), (wire.EXECUTION, 32), (wire.POSITION, 20), (wire.HEARTBEAT, 16), (wire.TRADE, 28), (wire.DEPTH, 32)])
def test_sizes(layout, size):
    assert layout.dtype.itemsize == size


def test_round_trip_and_bytes(spark):
    df = spark.createDataFrame([(1, 5, 2.5, 7, 9), (2, None, 1.0, 1, 1)], "k int, timestamp_us long, price double, size int, ticker_id int")
    sent = wire.encode(df, wire.TRADE)
    rows = {r.k: r.message for r in sent.collect()}
    assert bytes(rows[1]) == struct.pack("<B3xqdii", 3, 5, 2.5, 7, 9) and rows[2] is None
    back = wire.decode(sent.select("k", "message"), "message", wire.TRADE).collect()
    assert [tuple(r) for r in back] == [(1, 5, 2.5, 7, 9)]


def test_bad_messages(spark):
    good = struct.pack("<B3xqdii", 3, 1, 1.0, 1, 1)
    df = spark.createDataFrame([(bytearray(good),), (bytearray(good[:-1]),), (bytearray(b"\x02" + good[1:]),), (None,)], "m binary")
    assert wire.decode(df, "m", wire.TRADE, errors="drop").count() == 1
    with pytest.raises(Exception, match="not a trade message"):
        wire.decode(df, "m", wire.TRADE).collect()
    assert wire.decode(df.where("false"), "m", wire.TRADE).count() == 0


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for suffix in ("parquet", "orc", "json"):
        getattr(df.write, suffix)(f"{tmp_path}/t.{suffix}")
        assert readers.read_table(spark, f"{tmp_path}/t.{suffix}").count() == 2
    df.write.csv(f"{tmp_path}/t.csv", header=True)
    assert readers.read_table(spark, f"{tmp_path}/t.csv", "x int, y string").where("x = 2").first().y == "b"
    with pytest.raises(ValueError):
        readers.read_table(spark, "t.xyz")


def test_bars_layout_prunes(spark, tmp_path):
    b = synthetic_bars(spark, 50, symbols=3).selectExpr("*", "'1min' AS interval")
    readers.write_bars(b, f"{tmp_path}/bars")
    got = readers.load_bars(spark, f"{tmp_path}/bars", ["S0001"], "1min", "2024-01-01 00:10:00", "2024-01-01 00:20:00")
    assert got.count() == 10
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert readers.in_years(got, "ts", 2024, 2024).count() == 10 and readers.in_years(got, "ts", 2023, 2023).count() == 0


def test_synthetic_is_deterministic(spark):
    a, b = (synthetic_trades(spark, 20).toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 100
    assert readers.ObjectStore("http://localhost:9000", "k", "s").options()["fs.s3a.connection.ssl.enabled"] == "false"


def test_journal(spark, tmp_path):
    f = spark.createDataFrame([(1, "LONG", 10.0, 1, "x")], "ts long, side string, price double, target_position int, more string")
    readers.append_fills(f, f"{tmp_path}/j")
    readers.append_fills(f, f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/j").count() == 2


def test_limit_orders_need_a_price(spark):
    rows = [(10.0, 1, 5, 2, 7), (0.0, 1, 5, 1, 7), (0.0, 1, 5, 2, 7)]
    good, df = (spark.createDataFrame(r, "limit_price double, ticker_id int, target int, order_type int, strategy_id int") for r in (rows[:2], rows))
    assert wire.encode(good, wire.TARGET).where("message IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="limit order"):
        wire.encode(df, wire.TARGET).collect()


def test_indexed_json_csv_types_and_counters(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"0": {"open": 1.5, "close": 2}, "7": {"open": null, "close": 3.25}}')
    got = readers.read_indexed_json(spark, f"{tmp_path}/a.json", "open double, close double").collect()
    assert sorted(map(tuple, got)) == [("0", 1.5, 2.0), ("7", None, 3.25)]
    (tmp_path / "b.csv").write_text("n,x,s\n1,2.5,a\n2,3.5,b\n")
    df = readers.read_table(spark, f"{tmp_path}/b.csv")
    assert [t for _, t in df.dtypes] == ["int", "double", "string"]
    seen_df, seen = readers.counted(df, "seen", total=F.sum("x"))
    seen_df.collect()
    assert seen.get == {"rows": 2, "total": 6.0}
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.txt")
    assert [tuple(r) for r in readers.ticker_ids(["B", "A"], spark).collect()] == [(1, "B"), (2, "A")]
