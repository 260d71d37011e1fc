"""Work that must not grow faster than its input: texts, files of a replay, parsed statements."""

import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.plans import bindings, files, market, streams
from tickloom.plans.bindings import Frames
from tickloom.sources import csv_quotes, statements


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_csv_files_come_in_texts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(files, "TEXT_LINES", 3)
    rows = spark.createDataFrame([(d, f"c{i}", i + 1) for d in ("20240102", "20240103") for i in range(8)], "day string, code string, n int")
    texts = files._file(rows, F.concat("day", F.lit(".csv")), F.lit("合约代码,成交量"), F.concat_ws(",", "code", "n"), ["day"], F.col("n"))
    got = texts.collect()
    assert len(got) == 6 and all(t.text.startswith("合约代码,成交量\n") and t.text.count("\n") <= 3 for t in got)
    parsed = csv_quotes.parse_quotes(texts).select("file", "trade_date", "instrument_id", "volume").collect()
    assert sorted((r.file, str(r.trade_date), r.instrument_id, r.volume) for r in parsed) == \
        sorted((f"{d.replace('-', '')}.csv", d, f"c{i}", i + 1.0) for d in ("2024-01-02", "2024-01-03") for i in range(8))


@pytest.mark.parametrize("parse", [csv_quotes.parse_quotes, csv_quotes.parse_positions])
def test_no_line_carries_its_text(spark, parse):
    texts = spark.createDataFrame([("a_20240102.csv", "合约代码,成交量\nx,1\n\ny,2")], "file string, text string")
    exploded = [p for p in plan(parse(texts)).splitlines() if "Generate explode" in p]
    assert len(exploded) == 1 and "[0]" not in exploded[0] and "_lines" not in exploded[0]


def test_cells_with_and_without_quotes(spark):
    text = '合约代码,开盘价,成交量,合约代码\n"a,b","1.5", 7 ,z\nc,"",x,\n d ,2\n'
    got = csv_quotes.parse_quotes(spark.createDataFrame([("q_20240102.csv", text), ("empty.csv", "\n"), ("none.csv", None)], "file string, text string"))
    assert sorted((r.instrument_id, r.open_price, r.volume) for r in got.collect()) == [("a,b", 1.5, 7.0), ("c", None, None), ("d", 2.0, None)]


def test_large_positions_equal_whole_files(spark, tmp_path):
    (tmp_path / "r_20240102.csv").write_bytes("交易日,合约代码,会员简称,多头持仓,空头持仓\n20240102,MO2405,甲,5,2\n20240102,MO2405,乙,1,4\n".encode("gb18030"))
    whole, large = (read(spark, str(tmp_path)).collect() for read in (csv_quotes.read_positions, csv_quotes.read_large_positions))
    assert sorted(whole) == sorted(large) and sorted(r.net_position for r in large) == [-3.0, 3.0]


def test_replay_files_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    monkeypatch.setenv("TZ", "UTC")
    start = datetime(2024, 1, 2)
    # One slice has a single distinct row, so that its other files hold nothing.
    rows = [(i, start + timedelta(seconds=i), i % 7, "view", float(i), '{"k": 1}') for i in range(360)]
    rows += [(1000, start + timedelta(days=1), 1, "view", 1.0, '{"k": 1}')] * 120
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    frames = Frames(spark, str(tmp_path))
    stream, work = streams._replayed(frames)
    written = spark.read.parquet(f"{work}/in")
    assert written.count() == 480 and len(written.inputFiles()) == 4 * (480 // 80)
    seen = []
    query = stream.writeStream.option("checkpointLocation", f"{work}/c").trigger(availableNow=True).foreachBatch(
        lambda batch, n: seen.append([r.ts for r in batch.select("ts").collect()])).start()
    query.awaitTermination()
    seen = [b for b in seen if b]
    assert sum(map(len, seen)) == 480 and all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False))


STATEMENT = "客户号 Client ID：C1\n日期 Date：20240102\n期初结存 Balance B/F：1,000.50\n  成交记录 Transaction Record\n|Date|a|b|c|d|e|f|g|h|i|j|k|l|m|n|o|p|Trade Time|\n"
DEAL = "|20240102|-|X|c|p|IC2406|买|投|5.00|2|10.00|开|1.00|0.00|0.00|T1|1|10:15:20|\n共 1 条\n"


def test_derived_statement_texts_are_built_once(spark):
    texts = spark.range(2).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("file"),
                                  F.concat(F.lit(STATEMENT + DEAL + "MARKER"), F.col("id").cast("string")).alias("text"))
    for found in (statements.summaries, statements.transactions, statements.closed_positions):
        assert plan(found(texts)).count("MARKER") == 1
    assert [(r.file, r.client_id, str(r.bill_date_start), r.balance_bf) for r in statements.summaries(texts).sort("file").collect()] == \
        [(f"{i}.txt", "C1", "2024-01-02", 1000.5) for i in range(2)]
    assert [(r.file, r.instrument, r.trade_time, r.volume) for r in statements.transactions(texts).sort("file").collect()] == \
        [(f"{i}.txt", "IC2406", "10:15:20", 2) for i in range(2)]


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, " \
        "l_linestatus string, l_shipdate timestamp_ntz"


@pytest.fixture
def facts(spark, tmp_path, monkeypatch):
    """Tables with 400 rows of facts, so that 10 rows for each task ask for 40 tasks."""
    monkeypatch.setattr(bindings, "TASK_ROWS", 10, raising=False)
    start = datetime(2024, 1, 30)
    lines = [(i, i % 9, i * 7 % 30, i % 4 + 1, float(i % 50 + 1), float(i), "OF"[i % 2], start + timedelta(days=i % 5)) for i in range(399)]
    lines.append((399, 1, None, 1, 1.0, 1.0, "O", None))
    tables = {"lineitem": (lines, LINES), "part": ([(k, f"B{k % 2}") for k in range(9)], "p_partkey long, p_brand string"),
              "supplier": ([(k, k % 2, 1.0) for k in range(29)], "s_suppkey long, s_nationkey int, s_acctbal double"),
              "nation": ([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Frames(spark, str(tmp_path)), lines


def dealt(df):
    """Keys of the shuffles whose number of tasks follows the rows."""
    return sorted(re.sub(r"#\w+", "", k) for k in re.findall(r"RepartitionByExpression \[(.*?)\], 40\b", plan(df)))


def test_position_tasks_follow_the_rows(facts):
    frames, lines = facts
    found = market.top_holders(frames)
    assert dealt(found) == ["trade_date, p_brand, l_suppkey"]
    volumes = defaultdict(int)
    for _, part, member, _, q, _, status, ts in lines:
        for side, flag in (("long", "O"), ("short", "F")):
            volumes[ts and ts.date().replace(day=1), f"B{part % 2}", side, member] += int(q) * (status == flag)
    tops = defaultdict(list)
    for (*key, _), v in volumes.items():
        tops[tuple(key)].append(v)
    got = defaultdict(list)
    for r in found.sort("position").collect():
        got[r.trade_date, r.contract_code, r.side].append(r.volume)
    assert got == {k: sorted(v, reverse=True)[:20] for k, v in tops.items()}


def test_daily_stats_tasks_follow_the_rows(facts):
    frames, lines = facts
    found = market.daily_market_stats(frames)
    assert dealt(found) == ["contract_code", "contract_code", "l_suppkey, trade_date"]
    days = defaultdict(lambda: [0, 0])
    for _, _, supplier, n, q, _, _, ts in lines:
        if supplier is not None and supplier < 29:
            days[supplier, ts.date()][0] += int(q)
            days[supplier, ts.date()][1] += n
    want = defaultdict(lambda: [0, 0, 0, 0])
    last = {}
    for (supplier, day), (volume, interest) in sorted(days.items()):
        change = interest - last.get(supplier, interest)
        last[supplier] = interest
        want[f"N{supplier % 2}", day] = [a + b for a, b in zip(want[f"N{supplier % 2}", day], (volume, interest, change, 1), strict=True)]
    assert {(r.product_code, r.trade_date): [r.total_volume, r.total_open_interest, r.total_oi_change or 0, r.contract_count]
            for r in found.collect()} == want
