"""Exchange files in their real layout, through all stages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import quality as q
from tapewatch.plans import stages
from tapewatch.schemas import EVENT_STREAM_FILE, ORDER_FILE, QUOTE_FILE, TRADE_FILE
from tapewatch.sources import market, raw_csv, tables

ORDERS = "自然日,时间,交易所委托号,委托代码,委托价格,委托数量,委托类型"
ORDERS_SHUFFLED = "委托数量,交易所委托号,自然日,时间,委托代码,委托价格,多余"
TRADES = "自然日,时间,成交代码,成交价格,成交数量,叫买序号,叫卖序号"
QUOTES = "万得代码,自然日,时间,成交价,申买价1,申卖价1,申买量1,申卖量1,前收盘"


def put(folder, name, encoding, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes("\n".join(lines).encode(encoding) + b"\n")


@pytest.fixture()
def base(tmp_path):
    one = tmp_path / "base" / "20250303" / "20250303" / "000989.SZ"
    put(one, ORDER_FILE, "gbk", ORDERS,
        "20250303,93000010,0001,B,10.0,100,0", "20250303,93000500,0002,S,10.2,200,0",
        "20250303,150000000,0003,B,10.0,100,0", "20250303,bad,0004,B,10.0,100,0", "20250303,100000000,0005,B,x,100,0")
    put(one, TRADE_FILE, "gbk", TRADES,
        "20250303,93000050,C,0,100,1,0", "20250303,93001000,0,10.1,200,1,2", "20250303,150001000,0,10.0,100,3,0",
        "20250303,100000100,0,10.0,100,5,99")
    put(one, QUOTE_FILE, "gbk", QUOTES,
        "x,20250303,93000000,10.0,9.9,10.1,500,300,9.8", "x,20250303,93000000,10.0,9.0,10.5,500,300,9.8",
        "x,20250303,93000450,10.0,10.0,10.2,500,300,9.8")
    # one folder level less, other column order, no quotes
    two = tmp_path / "base" / "20250304" / "300233.SZ"
    put(two, ORDER_FILE, "gbk", ORDERS_SHUFFLED, "300,0007,20250304,130000000,卖,5.5,-")
    put(two, TRADE_FILE, "gbk", TRADES, "20250304,130000020,C,0,300,0,7")
    # orders without trades give nothing
    put(tmp_path / "base" / "20250304" / "000001.SZ", ORDER_FILE, "gbk", ORDERS, "20250304,93000010,1,B,10.0,100,0")
    (tmp_path / "base" / "notes").mkdir()
    return str(tmp_path / "base")


def test_files_to_event_stream(spark, base, tmp_path):
    out = str(tmp_path / "stream")
    summary = {r.trade_date: (r.tickers, r.orders, r.rows) for r in stages.run_event_stream(spark, base, out).collect()}
    assert summary == {"20250303": (1, 3, 3), "20250304": (1, 1, 1)}
    rows = {r.order_id: r for r in tables.read_table(spark, out).collect()}
    first = rows["1"]
    assert (first.event_type, first.survival_ms, first.event_side) == ("cancel", 40.0, "B")
    # two quotes share the instant 09:30:00: the first of the file counts
    assert (first.bid1, first.quote_ts) == (9.9, datetime(2025, 3, 3, 9, 30))
    # 100 ms after the last grid point, which shows the quote before it
    assert (rows["2"].bid1, rows["2"].order_amount) == (9.9, pytest.approx(2040.0))
    assert rows["5"].order_price is None and rows["5"].bid1 is None
    assert (rows["7"].side, rows["7"].order_qty, rows["7"].order_price, rows["7"].bid1) == ("S", 300.0, 5.5, None)
    everything = stages.run_event_stream(spark, base, str(tmp_path / "all"), trading_hours_only=False)
    assert everything.agg(F.sum("rows")).first()[0] == 5


def test_allow_lists_and_days(spark, base):
    orders = raw_csv.read_raw_orders(spark, base, dates=["20250303"], tickers=["000989.SZ"])
    assert orders.count() == 5 and {r.ticker for r in orders.collect()} == {"000989.SZ"}
    days = {tuple(r) for r in raw_csv.available_days(spark, base).collect()}
    assert days == {("20250303", "000989.SZ"), ("20250304", "300233.SZ"), ("20250304", "000001.SZ")}


def test_headers_are_matched_by_name(spark, base):
    row = raw_csv.read_raw_orders(spark, base, tickers=["300233.SZ"]).first()
    assert (row.order_id, row.order_qty, row.order_price, row.side, row.order_type) == ("0007", "300", "5.5", "卖", None)


def test_wrong_encoding_is_noticed(spark, base):
    good = q.undecodable_text(raw_csv.read_raw_orders(spark, base), ["side"]).first()
    assert good["side"] == 0
    paths = raw_csv.table_paths(spark, base, ORDER_FILE, tickers=["300233.SZ"])
    wrong = spark.read.option("encoding", "utf-8").csv(paths)
    assert q.undecodable_text(wrong, wrong.columns).first()["_c4"] > 0


def test_stages_from_table_to_table(spark, base, tmp_path):
    stream, labels, features = (str(tmp_path / n) for n in ("stream", "labels", "features"))
    stages.run_event_stream(spark, base, stream)
    summary = {r.trade_date: (r.samples, r.positives) for r in stages.run_labels(spark, stream, labels).collect()}
    assert summary == {"20250303": (3, 0), "20250304": (1, 0), None: (4, 0)}
    stages.run_features(spark, stream, features)
    stages.run_features(spark, stream, features, dates=["20250304"])
    again = tables.read_features(spark, str(tmp_path))
    assert again.count() == 4 and "survival_ms" not in again.columns
    found = tables.read_labels(spark, str(tmp_path)).where("order_id = '1'").first()
    assert found.flag_R1 and not found.flag_R2


def test_partitions_are_pruned(spark, base, tmp_path):
    stream = str(tmp_path / "stream")
    stages.run_event_stream(spark, base, stream)
    day = tables.read_table(spark, stream, dates=["20250304"], columns=["ticker", "order_id"])
    plan = day._jdf.queryExecution().toString()
    assert "trade_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<ticker:string,order_id:string>" in plan
    assert day.count() == 1


def test_exported_event_stream_is_read_back(spark, tmp_path):
    day = tmp_path / "events" / "20250303"
    put(day, EVENT_STREAM_FILE, "utf-8-sig",
        "自然日,ticker,交易所委托号,委托_datetime,事件_datetime,方向_委托,事件类型,委托价格,委托数量,Unnamed: 0",
        "20250303,A,1,2025-03-03 09:30:00.010,2025-03-03 09:30:00.050,买,撤单,10.5,100,0",
        "20250303,A,2,broken,2025-03-03 09:30:00.050,卖,成交,10.5,100,0")
    from tapewatch.operators.features import typed_events

    text = raw_csv.read_event_stream_csv(spark, str(tmp_path / "events"))
    rows = typed_events(text).collect()
    assert [(r.trade_date, r.order_id, r.side, r.event_type, r.order_price) for r in rows] == [("20250303", "1", "B", "cancel", 10.5)]
    assert rows[0].order_ts == datetime(2025, 3, 3, 9, 30, 0, 10000)


def test_price_line_times(spark):
    rows = [("20250303", "93000000", 1.0), ("20250303", "9300001", 2.0), ("20250303", "143000500", 3.0), ("20250303", "junk", 4.0), ("20250303", "93000000", 5.0)]
    df = spark.createDataFrame([("20250303", "A", *r) for r in rows], "trade_date string, ticker string, date string, time string, trade_price double")
    line = market.price_line(df).orderBy("quote_ts").collect()
    assert [r.price for r in line] == [1.0, 2.0, 3.0]
    assert [r.quote_ts.time().isoformat() for r in line] == ["09:30:00", "09:30:00.010000", "14:30:00.500000"]


def test_checked_input(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert q.checked_input(df, ["a"]) is df
    with pytest.raises(ValueError):
        q.checked_input(df, ["b"])
    with pytest.raises(ValueError):
        q.checked_input(df.where("a > 1"), ["a"])


def test_repeated_names_and_trusted_headers(spark, tmp_path):
    one = tmp_path / "base" / "20250303" / "000989.SZ"
    put(one, ORDER_FILE, "gbk", ORDERS + ",委托价格", "20250303,93000010,1,B,10.0,100,0,99")
    base = str(tmp_path / "base")
    for mixed in (True, False):
        assert [(r.order_price, r.order_qty) for r in raw_csv.read_raw_orders(spark, base, mixed_headers=mixed).collect()] == [("10.0", "100")]
    plain = tmp_path / "plain" / "20250303"
    put(plain / "000989.SZ", ORDER_FILE, "gbk", ORDERS, "20250303,93000010,1,B,10.0,100,0")
    assert raw_csv.read_raw_orders(spark, str(tmp_path / "plain"), mixed_headers=False).first().order_price == "10.0"
    put(plain / "300233.SZ", ORDER_FILE, "gbk", "自然日,时间,交易所委托号,委托代码,委托数量,委托价格,委托类型", "20250303,93000010,2,B,100,10.5,0")
    with pytest.raises(Exception, match="(?i)header|conform"):
        raw_csv.read_raw_orders(spark, str(tmp_path / "plain"), mixed_headers=False).collect()
    prices = {r.order_price for r in raw_csv.read_raw_orders(spark, str(tmp_path / "plain")).collect()}
    assert prices == {"10.0", "10.5"}


def test_many_header_variants(spark, tmp_path):
    for k in range(70):
        put(tmp_path / "base" / "20250303" / f"{k:06d}.SZ", ORDER_FILE, "gbk", f"x{k}," + ORDERS, f"0,20250303,93000010,{k},B,10.0,100,0")
    rows = raw_csv.read_raw_orders(spark, str(tmp_path / "base")).collect()
    assert sorted(int(r.order_id) for r in rows) == list(range(70)) and {r.order_price for r in rows} == {"10.0"}


def test_headers_come_from_file_heads(spark, tmp_path):
    """Three header variants in files of some size: beside the rows no more than the heads of the files are read."""
    variants = [ORDERS, ORDERS_SHUFFLED, "x,y," + ORDERS]
    makers = [
        lambda k: f"20250303,93000010,{k},B,10.0,{k % 7},0", lambda k: f"{k % 7},{k},20250303,93000010,B,10.0,", lambda k: f"a,b,20250303,93000010,{k},B,10.0,{k % 7},0",
    ]
    size = 0
    for v, (header, make) in enumerate(zip(variants, makers)):
        for f in range(2 if v else 4):
            place = tmp_path / "base" / "20250303" / f"{v}{f}.SZ"
            put(place, ORDER_FILE, "gbk", header, *[make(k) for k in range(15000)])
            size += (place / ORDER_FILE).stat().st_size
    put(tmp_path / "base" / "20250303" / "none.SZ", ORDER_FILE, "gbk", "something,else", "1,2")
    put(tmp_path / "base" / "20250303" / "empty.SZ", ORDER_FILE, "gbk", "")
    paths = raw_csv.table_paths(spark, str(tmp_path / "base"), ORDER_FILE)
    heads = raw_csv.file_heads(spark, paths, "gbk")
    assert heads.agg(F.sum("bytes")).first()[0] <= 0.01 * size + 2 * raw_csv.HEAD_BYTES
    rows = raw_csv.read_raw_orders(spark, str(tmp_path / "base"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "BroadcastHashJoin" in plan
    found = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("order_id").cast("long")).alias("ids"), F.sum(F.col("order_qty").cast("long")).alias("qty")).collect()
    wanted = (15000, sum(range(15000)), sum(k % 7 for k in range(15000)))
    assert {r.ticker: tuple(r)[1:] for r in found} == {f"{v}{f}.SZ": wanted for v in range(3) for f in range(2 if v else 4)}


def test_files_that_agree_are_not_joined(spark, tmp_path):
    for k in range(3):
        put(tmp_path / "base" / "20250303" / f"{k}.SZ", ORDER_FILE, "gbk", ORDERS, f"20250303,93000010,{k},B,10.0,100,0")
    rows = raw_csv.read_raw_orders(spark, str(tmp_path / "base")).select("order_id", "ticker")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReadSchema: struct<_c2:string>" in plan
    assert {(r.order_id, r.ticker) for r in rows.collect()} == {(str(k), f"{k}.SZ") for k in range(3)}


def test_long_and_late_first_lines(tmp_path):
    for name, text, line in (("long", "a," * 9000 + "z\n1,2\n", "a," * 9000 + "z"), ("late", "\n \r\n自然日,b\r\n1,2", "自然日,b\r"), ("single", "a,b", "a,b"), ("none", "", None)):
        (tmp_path / name).write_bytes(text.encode("gbk"))
        found, size = raw_csv.head_reader("gbk")((tmp_path / name).as_uri())
        assert found == line and size <= max(raw_csv.HEAD_BYTES, len(text) + raw_csv.HEAD_BYTES)
