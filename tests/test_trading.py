import random
from collections import deque

import pytest

from tickloom.operators import trading

SCHEMA = ("id bigint, trade_date string, instrument string, exchange string, product string, direction string, "
          "offset_flag string, volume bigint, price double, commission double, premium double")


def frame(spark, rows):
    from pyspark.sql import functions as F
    full = [(i + 1, r.get("date", f"2025-01-{i % 27 + 1:02d}"), r["ins"], "X", "p", r["dir"], r["off"], r["vol"], float(r.get("px", 0)),
             float(r.get("com", 0)), float(r.get("prem", 0))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("trade_date", F.col("trade_date").cast("date"))


def t(ins, direction, off, vol, px=0, **kw):
    return {"ins": ins, "dir": direction, "off": off, "vol": vol, "px": px, **kw}


def matches(spark, rows, **kw):
    return sorted(trading.match_trades(frame(spark, rows), **kw).collect(), key=lambda r: (r.instrument, r.open_trade_id, r.close_trade_id))


def test_full_close(spark):
    [m] = matches(spark, [t("rb2505", "buy", "open", 1, 3500, com=5), t("rb2505", "sell", "close", 1, 3600, com=5)])
    assert (m.price_pnl, m.money_pnl, m.commission, m.net_pnl, m.multiplier) == (100, 1000, 10, 990, 10)


def test_fifo_partial_and_remaining_open(spark):
    ms = matches(spark, [t("IF2503", "buy", "open", 1, 4000), t("IF2503", "buy", "open", 2, 4050), t("IF2503", "buy", "open", 3, 4100),
                         t("IF2503", "sell", "close", 3, 4150)])
    assert [(m.open_volume, m.price_pnl) for m in ms] == [(1, 150), (2, 100)]


def test_split_closes(spark):
    ms = matches(spark, [t("m2505", "buy", "open", 5, 3000), t("m2505", "sell", "close", 2, 3100), t("m2505", "sell", "close", 3, 3200)])
    assert [(m.close_volume, m.price_pnl) for m in ms] == [(2, 100), (3, 200)]


def test_long_and_short_books_are_separate(spark):
    ms = matches(spark, [t("cu2503", "buy", "open", 2, 68000), t("cu2503", "sell", "open", 1, 68500), t("cu2503", "sell", "close", 2, 69000),
                         t("cu2503", "buy", "close", 1, 68200)])
    assert {m.open_direction: (m.price_pnl, m.money_pnl) for m in ms} == {"long": (1000, 10000), "short": (300, 1500)}


def test_futures_whose_product_ends_in_c_or_p(spark):
    ms = matches(spark, [t("IC2503", "buy", "open", 1, 5800, com=10), t("IC2503", "sell", "close", 1, 5900, com=10),
                         t("PP2505", "sell", "open", 2, 7000), t("PP2505", "buy", "close_today", 2, 6990),
                         t("AP505", "buy", "open", 1, 100), t("AP505", "sell", "close", 1, 101),
                         t("P2505", "buy", "open", 1, 8000), t("P2505", "sell", "close", 1, 8002)])
    assert {m.instrument: (m.is_option, m.money_pnl, m.net_pnl) for m in ms} == {
        "IC2503": (0, 20000, 19980), "PP2505": (0, 100, 100), "AP505": (0, 10, 10), "P2505": (0, 20, 20)}
    from tickloom.functions.scalars import is_option
    frame_ = spark.createDataFrame([("MO2503-C-6500",), ("SR505P6000",), ("m2505-C-3000",), ("CP2505",)], "i string")
    assert [r[0] for r in frame_.select(is_option("i")).collect()] == [True, True, True, False]


def test_option_premiums(spark):
    [c] = matches(spark, [t("MO2503-C-6500", "buy", "open", 1, prem=15000), t("MO2503-C-6500", "sell", "close", 1, prem=18000)])
    assert (c.is_option, c.price_pnl, c.premium_pnl, c.money_pnl) == (1, 0, 3000, 3000)
    [p] = matches(spark, [t("MO2503-P-6000", "sell", "open", 1, prem=8000), t("MO2503-P-6000", "buy", "close", 1, prem=5000)])
    assert (p.open_direction, p.premium_pnl) == ("short", 3000)


def test_open_only_and_empty(spark):
    assert matches(spark, [t("rb2505", "buy", "open", 1, 3500)]) == []
    assert trading.match_trades(frame(spark, [t("rb2505", "buy", "open", 0, 1)]).limit(0)).count() == 0


def brute(rows, causal=False):
    """Queue matcher in (date, id) order."""
    out = set()
    books = {}
    for i, r in sorted(enumerate(rows, 1), key=lambda x: (x[1]["date"], x[0])):
        buy, opens = r["dir"] == "buy", r["off"] == "open"
        side = ("long" if buy else "short") if opens else ("short" if buy else "long")
        books.setdefault((r["ins"], side), []).append((i, opens, r["vol"]))
    for (ins, side), legs in books.items():
        queue = deque()
        if not causal:
            queue.extend([i, v] for i, o, v in legs if o)
        for i, o, v in legs:
            if o:
                if causal:
                    queue.append([i, v])
                continue
            while v > 0 and queue:
                if queue[0][1] == 0:
                    queue.popleft()
                    continue
                take = min(v, queue[0][1])
                out.add((ins, side, queue[0][0], i, take))
                queue[0][1] -= take
                v -= take
                if queue[0][1] == 0:
                    queue.popleft()
    return out


@pytest.mark.parametrize("causal", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_books_match_a_queue(spark, seed, causal):
    rnd = random.Random(seed)
    rows = [t("hot" if rnd.random() < 0.35 else f"u{rnd.randrange(8)}", rnd.choice(["buy", "sell"]), rnd.choice(["open", "close", "平今"]),
              rnd.randrange(0, 9), 10, date=f"2025-01-{rnd.randrange(1, 28):02d}") for _ in range(700)]
    ms = trading.match_trades(frame(spark, rows), enforce_time_order=causal, block_ids=13, lane_width=29).collect()
    got = {(m.instrument, m.open_direction, m.open_trade_id, m.close_trade_id, m.open_volume) for m in ms}
    assert got == brute(rows, causal)
    assert len(got) == len(ms)


def test_performance_attributes(spark):
    ms = trading.match_trades(frame(spark, [t("MO2503-C-6500", "buy", "open", 2, 10, prem=100, date="2025-01-02"),
                                            t("MO2503-C-6500", "sell", "close", 2, 12, prem=160, date="2025-02-10")]))
    [p] = trading.trade_performance(ms).collect()
    assert (p.underlying, p.option_type, p.strike, str(p.expiry)) == ("MO", "call", 6500.0, "2025-03-31")
    assert (p.close_year, p.close_month, p.close_quarter, p.holding_days) == (2025, 2, 1, 39)
    assert p.pnl_ratio == pytest.approx(120 / (10 * 2 * 100))


def test_slippage_rules(spark):
    q = spark.createDataFrame([("A", "d1", 120.0, 90.0, 100.0, 0.0, 0.0), ("A", "d2", 120.0, 90.0, 0.0, 100.0, 1.0), ("A", "d3", None, None, 0.0, 0.0, 0.0)],
                              "contract_code string, trade_date string, high double, low double, vwap double, settle double, close double")
    tr = spark.createDataFrame([(1, "A", "d1", "buy", 106.0), (2, "A", "d2", "sell", 94.0), (3, "A", "d1", "buy", 94.0), (4, "B", "d1", "buy", 1.0),
                                (5, "A", "d3", "buy", 1.0)], "id int, contract_code string, trade_date string, direction string, price double")
    out = trading.reconcile_trades(tr, q)
    got = {r.id: (r.status, r.slippage_pct) for r in out.collect()}
    assert got == {1: ("alert", 6.0), 2: ("alert", -6.0), 3: ("ok", -6.0), 4: ("no_quote", None), 5: ("no_ref_price", None)}
    [rep] = trading.slippage_report(out).collect()
    assert (rep.total_trades, rep.matched_quotes, rep.no_quotes, rep.alert_count, rep.avg_slippage_pct, rep.max_slippage_pct) == (5, 3, 1, 2, 6.0, 6.0)


def test_balance_check(spark):
    rows = [(1000.0, c, 100.0, 50.0, 10.0) for c in (1140.0, 1200.0, 1300.0)]
    df = spark.createDataFrame(rows, ["期初权益", "balance_closing", "入金", "平仓盈亏", "手续费"])
    assert [r.balance_status for r in trading.balance_check(df).collect()] == ["balanced", "suspicious", "unbalanced"]


def test_fund_flow_identity(spark):
    fl = spark.createDataFrame([(1, float(a)) for a in (100000, -50000, 15000, -2000, 5000, -18000)], "bill_id bigint, amount double")
    b = spark.createDataFrame([(1, 1000000.0, 1050000.0)], "id bigint, balance_bf double, balance_cf double")
    [r] = trading.flow_identity(fl, b).collect()
    assert (r.flow_total, r.balance_change, r.balanced) == (50000.0, 50000.0, True)
