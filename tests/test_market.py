from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import bars, calendar as cal, contracts, quality as qa


def test_five_minute_bar_drops_null_close_first(spark):
    rows = [(10, 11, 9, 10, 1, 10), (10, 12, 10, 11, 2, 22), (11, 11, 8, 9, 3, 27), (9, 10, 9, None, 4, 40), (9, 9, 7, 8, 5, 40)]
    df = spark.createDataFrame(
        [("X", "c", datetime(2024, 1, 2, 9, 30 + i), float(o), float(h), float(l), None if c is None else float(c), v, float(t), i)
         for i, (o, h, l, c, v, t) in enumerate(rows)],
        "exchange string, contract_code string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, turnover double, open_interest bigint")
    [b] = bars.resample(df, ["5min"]).collect()
    assert (b.open, b.high, b.low, b.close, b.volume, b.turnover, b.vwap, b.trade_time) == (10, 12, 7, 8, 11, 99, 9.0, "09:30:00")
    multi = {r.frequency: r for r in bars.resample(df).collect()}
    assert set(multi) == set(bars.TARGET_FREQUENCIES) and all(r.close == 8 and r.open == 10 for r in multi.values())


def test_weekly_label_is_the_sunday(spark):
    rows = [("c", date(2024, 1, 1) + timedelta(days=i), 1.0, 2.0, 0.5, float(i), 1, 1.0, i) for i in range(8)]
    df = spark.createDataFrame(rows, "contract_code string, trade_date date, open double, high double, low double, close double, volume bigint, turnover double, open_interest bigint")
    got = {str(r.week_end): r.close for r in bars.daily_to_weekly(df).collect()}
    assert got == {"2024-01-07": 6.0, "2024-01-14": 7.0}


def _quotes(spark, oi):
    rows = [("IM2601", 30000, 50000), ("IM2603", 60000, 80000), ("IM2606", 15000, 20000)]
    q = spark.createDataFrame([(c, o if oi else None, v) for c, o, v in rows], "contract_code string, open_interest bigint, volume bigint") \
        .withColumn("trade_date", F.lit("2026-01-15").cast("date"))
    c = spark.createDataFrame([(c, "IM", "active") for c, _, _ in rows], "contract_code string, product_code string, status string")
    return q, c


@pytest.mark.parametrize("oi", [True, False])
def test_main_contract(spark, oi):
    [m] = contracts.main_contracts(*_quotes(spark, oi)).collect()
    assert m.contract_code == "IM2603"


def test_manual_main_contract_and_rollover(spark):
    m = spark.createDataFrame([("IF", "2026-03-01", "IF2603"), ("IF", "2026-03-02", "IF2603"), ("IF", "2026-03-03", "IF2606")],
                              "product_code string, d string, contract_code string").select("product_code", F.col("d").cast("date").alias("trade_date"), "contract_code")
    q, c = _quotes(spark, True)
    [r] = contracts.rollovers(contracts.main_contracts(q, c, m).filter("product_code = 'IF'")).collect()
    assert (str(r.trade_date), r.from_contract, r.to_contract) == ("2026-03-03", "IF2603", "IF2606")
    both = {r.product_code: r.method for r in contracts.main_contracts(q, c, m).collect()}
    assert both == {"IM": "volume_oi", "IF": "manual"}


# ------------------------------------------------------------------ calendar

def resolved(spark, holidays, overrides=None, exchange="ALL"):
    days = cal.day_range(spark, "2025-12-25", "2026-02-10")
    h = spark.createDataFrame([(x, "h") for x in holidays], "d string, holiday_name string").select(F.col("d").cast("date").alias("trade_date"), "holiday_name")
    o = None
    if overrides:
        o = spark.createDataFrame(overrides, "exchange_code string, d string, override_type string") \
            .select("exchange_code", F.col("d").cast("date").alias("trade_date"), "override_type")
    c = cal.build_calendar(days, h)
    if exchange != "ALL":
        c = c.withColumn("exchange_code", F.lit(exchange))
    return cal.resolve_calendar(days, c, o, exchange)


def one(spark, d, **kw):
    return spark.createDataFrame([(d,)], "d string").select(F.col("d").cast("date").alias("trade_date"))


@pytest.mark.parametrize("start,n,want", [("01-05", 1, "01-06"), ("01-09", 1, "01-12"), ("01-01", 1, "01-05"), ("01-12", -1, "01-09"),
                                          ("01-05", 3, "01-08"), ("01-08", -3, "01-05"), ("01-11", -1, "01-09")])
def test_add_trading_days(spark, start, n, want):
    r = resolved(spark, ["2026-01-01", "2026-01-02"])
    assert str(cal.add_trading_days(one(spark, f"2026-{start}"), r, n).collect()[0].target_date) == f"2026-{want}"


def test_counts_and_offsets(spark):
    r = resolved(spark, ["2026-01-01", "2026-01-02"])
    spans = [("01-05", "01-09", 5), ("01-05", "01-12", 6), ("01-01", "01-09", 5), ("01-09", "01-05", 0)]
    df = spark.createDataFrame([(i, f"2026-{a}", f"2026-{b}") for i, (a, b, _) in enumerate(spans)], "i int, a string, b string") \
        .select("i", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    got = {x.i: x.trading_days for x in cal.count_trading_days(df, r, "a", "b").collect()}
    assert [got[i] for i in range(4)] == [s[2] for s in spans]
    off = {x.i: x.offset for x in cal.trading_day_offset(df, r, "a", "b").collect()}
    assert (off[0], off[3]) == (4, -4)


def test_month_edges_and_snap(spark):
    r = resolved(spark, ["2026-01-01"])
    e = {(x.year, x.month): (str(x.first_day), str(x.last_day)) for x in cal.month_edges(r).collect()}
    assert e[(2026, 1)] == ("2026-01-02", "2026-01-30")
    got = [str(cal.snap(one(spark, "2026-01-03"), r, d).collect()[0].snapped) for d in ("forward", "backward", "nearest")]
    assert got == ["2026-01-05", "2026-01-02", "2026-01-02"]


def test_override_precedence(spark):
    r = resolved(spark, [], [("ALL", "2026-01-10", "workday"), ("ALL", "2026-01-12", "holiday"), ("ALL", "2026-01-13", "holiday"),
                             ("CFFEX", "2026-01-13", "half_day")], "CFFEX")
    got = {str(x.trade_date): x.is_trading for x in r.collect()}
    assert (got["2026-01-10"], got["2026-01-12"], got["2026-01-13"], got["2026-01-11"]) == (True, False, True, False)


def test_sessions(spark):
    t = spark.range(1).selectExpr("'d' as template_id", "array(named_struct('start','09:30','end','11:30'), named_struct('start','13:00','end','15:00')) as normal_schedule",
                                  "array(named_struct('start','21:00','end','02:30')) as night_schedule")
    times = ["10:00", "12:00", "14:00", "15:30", "22:00", "23:00", "01:00", "02:30", "03:00", "16:00"]
    df = spark.createDataFrame([("d", x) for x in times], "template_id string, trade_time string")
    kept = {r.trade_time for r in cal.within_sessions(df, cal.template_sessions(t)).collect()}
    assert kept == {"10:00", "14:00", "22:00", "23:00", "01:00", "02:30"}


# ------------------------------------------------------------------ quality

def test_minute_completeness_bands(spark):
    counts = {"d1": 240, "d2": 220, "d3": 200, "d4": 100, "d5": 0}
    rows = [("c", d, "1min") for d, n in counts.items() for _ in range(n)]
    m = spark.createDataFrame(rows, "contract_code string, trade_date string, frequency string")
    exp = spark.createDataFrame([("c", d, "1min") for d in counts], "contract_code string, trade_date string, frequency string")
    days = qa.minute_completeness(m, exp)
    got = {r.trade_date: (r.status, r.completeness_pct) for r in days.collect()}
    assert got["d1"] == ("complete", 100.0) and got["d2"][0] == "complete" and got["d3"][0] == "partial"
    assert got["d4"][0] == "incomplete" and got["d5"] == ("missing", 0.0)
    [s] = qa.minute_range_score(days.filter("trade_date in ('d1','d3','d5')")).collect()
    assert s.overall_pct == 50.0


def test_verdict(spark):
    def run(*status):
        return qa.verdict(spark.createDataFrame([(s,) for s in status], "status string")).collect()[0].overall

    assert [run("PASS"), run("PASS", "WARN"), run("WARN", "FAIL"), run("SKIP")] == ["TRUSTWORTHY", "QUESTIONABLE", "UNRELIABLE", "NO_DATA"]


def test_contract_sync(spark):
    cur = spark.createDataFrame([("A", None, "active"), ("B", None, "active"), ("C", "2024-01-01", "delisted")], "contract_code string, delisting_date string, status string")
    new = spark.createDataFrame([("A", "2025-01-01"), ("B", None), ("D", None)], "contract_code string, delisting_date string")
    got = {r.contract_code: (r.status, r.sync_action) for r in contracts.sync_contract_master(cur, new).collect()}
    assert got == {"A": ("delisted", "updated"), "B": ("active", "unchanged"), "C": ("delisted", "unchanged"), "D": ("active", "inserted")}
    forced = {r.contract_code: (r.status, r.sync_action) for r in contracts.sync_contract_master(cur, new, force=True).collect()}
    assert forced["A"] == ("active", "updated") and forced["B"] == ("active", "updated")


def test_scalar_edge_cases(spark):
    df = spark.createDataFrame([("1,234.5 ", "2025-01-02", "MO2505C8500.CFFEX"), ("-", "20250102", "IF2505"), ("", "x", "MO2505P8500")], "n string, d string, v string")
    rows = df.select(S.clean_number("n").alias("n"), S.normalize_date("d").alias("d"), S.vendor_to_contract("v").alias("v"), S.vendor_option_type("v").alias("o")).collect()
    assert [r.n for r in rows] == [1234.5, 0.0, 0.0]
    assert [str(r.d) for r in rows] == ["2025-01-02", "2025-01-02", "None"]
    assert [(r.v, r.o) for r in rows] == [("MO2505-C-8500", "call"), ("IF2505", None), ("MO2505-P-8500", "put")]
