from pyspark.sql import functions as F

from tickloom.client import Client


def test_filters_summaries_and_pushdown(spark, tmp_path):
    q = spark.createDataFrame([("X", c, f"2024-01-0{d}", float(d), 10 * d) for c in "ab" for d in (1, 2, 3)],
                              "exchange string, contract_code string, d string, close double, volume bigint") \
        .select("exchange", "contract_code", F.col("d").cast("date").alias("trade_date"), "close", "volume")
    q.write.parquet(str(tmp_path / "daily_quotes"))
    c = Client(spark, root=str(tmp_path))
    rows = c.quotes(contract="a", start_date="2024-01-02")
    assert [r.close for r in rows.collect()] == [2.0, 3.0]
    assert "EqualTo(contract_code,a)" in rows._jdf.queryExecution().toString()
    [s] = c.quote_summary("b").collect()
    assert (s.data_points, s.avg_close, s.max_volume) == (3, 2.0, 30)
    assert c.status(["daily_quotes"]).collect()[0].row_count == 6


def test_top_holders_and_iv_snapshot(spark):
    p = spark.createDataFrame([("2024-01-02", "A", f"m{i}", i, 10 - i) for i in range(5)], "trade_date string, contract_code string, member_name string, long_volume int, short_volume int")
    o = spark.createDataFrame([("2024-01-02", "MO1", 0.3), ("2024-01-03", "MO1", 0.5), ("2024-01-03", "MO2", 0.4), ("2024-01-03", "IO1", 0.1), ("2024-01-03", "MO3", None)],
                              "trade_date string, contract_code string, iv double")
    c = Client(spark, tables={"position_detail": p, "option_features": o})
    top = c.top_holders("A", "2024-01-02", 2).collect()
    assert {(r.side, r.member_name) for r in top} == {("long", "m4"), ("long", "m3"), ("short", "m0"), ("short", "m1")}
    assert [r.contract_code for r in c.iv_snapshot("MO").collect()] == ["MO2", "MO1"]
    assert c.positions(contract="A").count() == 5
