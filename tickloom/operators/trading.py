"""Trades, statements and P&L."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators.ordered import Scan, id_block, prefix_scan

TRADE_FIELDS = ["id", "trade_date", "price", "volume", "premium", "commission", "exchange", "product"]
BLOCK_IDS = 1_000_000
LANE_WIDTH = 1_000_000


# ------------------------------------------------------------------ FIFO matching

def _classified(trades: DataFrame) -> DataFrame:
    """Split trades into the long and short book, opens and closes; zero volumes drop out."""
    buy = F.coalesce(F.col("direction") == "buy", F.lit(False))
    opens = F.coalesce(F.col("offset_flag") == "open", F.lit(False))
    side = F.when(opens, F.when(buy, "long").otherwise("short")) \
            .otherwise(F.when(buy, "short").otherwise("long"))
    cols = {c: F.col(c) if c in trades.columns else F.lit(None).cast("string") for c in TRADE_FIELDS}
    zero = F.lit(0.0)
    cols["price"] = F.coalesce(cols["price"].cast("double"), zero)
    cols["premium"] = F.coalesce(cols["premium"].cast("double"), zero)
    cols["commission"] = F.coalesce(cols["commission"].cast("double"), zero)
    cols["volume"] = F.coalesce(cols["volume"].cast("bigint"), F.lit(0))
    return trades.select("instrument", side.alias("side"),
                         F.when(opens, "open").otherwise("close").alias("role"),
                         *[c.alias(n) for n, c in cols.items()]).filter(F.col("volume") > 0)


def _lanes(rows: DataFrame, block_ids: int) -> DataFrame:
    """Place each trade on its book's volume axis: the half-open range [lo, hi)."""
    rows = rows.withColumn("_idb", id_block("id", block_ids))
    out = prefix_scan(rows, ["instrument", "side", "role"], ["trade_date", "_idb"],
                      ["trade_date", "id"], [Scan("hi", "sum", F.col("volume"))])
    return out.withColumn("lo", F.col("hi") - F.col("volume")).drop("_idb")


def _causal_lanes(rows: DataFrame, block_ids: int) -> DataFrame:
    """As ``_lanes``, but a close only consumes volume opened before it.

    Excess closes are discarded as they occur: with O and C the running open and close volume,
    the discarded volume after a trade is max(0, running max of C - O).
    """
    is_open = F.col("role") == "open"
    rows = rows.withColumn("_idb", id_block("id", block_ids))
    keys, block, order = ["instrument", "side"], ["trade_date", "_idb"], ["trade_date", "id"]
    run = prefix_scan(rows, keys, block, order, [
        Scan("_o", "sum", F.when(is_open, F.col("volume")).otherwise(0)),
        Scan("_c", "sum", F.when(~is_open, F.col("volume")).otherwise(0))])
    run = run.withColumn("_gap", F.col("_c") - F.col("_o"))
    run = prefix_scan(run, keys, block, order, [
        Scan("_peak", "max", F.col("_gap")),
        Scan("_peak_before", "max", F.col("_gap"), inclusive=False)])
    lost = F.greatest(F.col("_peak"), F.lit(0))
    lost_before = F.greatest(F.coalesce("_peak_before", F.lit(0)), F.lit(0))
    lo = F.when(is_open, F.col("_o") - F.col("volume")) \
          .otherwise(F.col("_c") - F.col("volume") - lost_before)
    hi = F.when(is_open, F.col("_o")).otherwise(F.col("_c") - lost)
    return run.withColumn("lo", lo).withColumn("hi", hi).filter(F.col("hi") > F.col("lo")) \
              .drop("_idb", "_o", "_c", "_gap", "_peak", "_peak_before")


def fifo_segments(trades: DataFrame, enforce_time_order: bool = False,
                  block_ids: int = BLOCK_IDS, lane_width: int = LANE_WIDTH) -> DataFrame:
    """First-in first-out pairing of opens and closes per instrument and side.

    Opens tile the volume axis, and so do closes; a match is the overlap of one open range and
    one close range. Both sets of range starts are merged and the current open and close are
    carried forward, so the work is linear in trades and never pairs all opens with all closes.
    """
    rows = _classified(trades)
    lanes = (_causal_lanes if enforce_time_order else _lanes)(rows, block_ids)
    payload = F.struct("hi", *TRADE_FIELDS)
    cuts = lanes.groupBy("instrument", "side", "lo").agg(
        F.max(F.when(F.col("role") == "open", payload)).alias("_open"),
        F.max(F.when(F.col("role") == "close", payload)).alias("_close")) \
        .withColumn("_lane", F.floor(F.col("lo") / F.lit(lane_width)).cast("bigint"))
    held = prefix_scan(cuts, ["instrument", "side"], ["_lane"], ["lo"], [
        Scan("open", "last", F.col("_open")), Scan("close", "last", F.col("_close"))])
    end = F.least(F.col("open.hi"), F.col("close.hi"))
    return held.filter(F.col("open").isNotNull() & F.col("close").isNotNull()) \
               .withColumn("matched_volume", end - F.col("lo")) \
               .filter(F.col("matched_volume") > 0) \
               .select("instrument", "side", "matched_volume", "open", "close")


def match_trades(trades: DataFrame, enforce_time_order: bool = False, **sizes) -> DataFrame:
    """Matched open / close pairs with P&L, pro-rated commission and premiums."""
    seg = fifo_segments(trades, enforce_time_order, **sizes)
    o, c = F.col("open"), F.col("close")
    mv = F.col("matched_volume")
    option = S.is_option("instrument")
    long = F.col("side") == "long"
    mult = S.multiplier("instrument")
    diff = F.when(long, c["price"] - o["price"]).otherwise(o["price"] - c["price"])
    oprem, cprem = F.abs(o["premium"]), F.abs(c["premium"])
    pdiff = F.when(long, cprem - oprem).otherwise(oprem - cprem)
    commission = o["commission"] / o["volume"] * mv + c["commission"] / c["volume"] * mv
    out = seg.select(
        "instrument", c["exchange"].alias("exchange"), c["product"].alias("product"),
        option.cast("int").alias("is_option"),
        o["id"].alias("open_trade_id"), o["trade_date"].alias("open_date"),
        o["price"].alias("open_price"), mv.alias("open_volume"),
        (oprem * mv / o["volume"]).alias("open_premium"),
        F.col("side").alias("open_direction"),
        c["id"].alias("close_trade_id"), c["trade_date"].alias("close_date"),
        c["price"].alias("close_price"), mv.alias("close_volume"),
        (cprem * mv / c["volume"]).alias("close_premium"),
        S.holding_days(o["trade_date"], c["trade_date"]).alias("holding_days"),
        F.when(option, F.lit(0.0)).otherwise(diff).alias("price_pnl"),
        F.when(option, pdiff * mv).otherwise(F.lit(0.0)).alias("premium_pnl"),
        mult.alias("multiplier"),
        F.when(option, pdiff * mv).otherwise(diff * mv * mult).alias("money_pnl"),
        commission.alias("commission"), F.lit("closed").alias("status"))
    return out.withColumn("net_pnl", F.col("money_pnl") - F.col("commission"))


def trade_performance(matched: DataFrame) -> DataFrame:
    """Option attributes, closing period and return on opening value."""
    parts = S.option_symbol_parts("instrument")
    opt = F.col("is_option") == 1
    base = F.col("open_price") * F.col("open_volume") * F.greatest(F.col("multiplier"), F.lit(1))
    return matched.select(
        "instrument", "is_option", "open_trade_id", "close_trade_id", "open_date", "close_date",
        "open_volume", "open_direction", "money_pnl", "premium_pnl", "commission", "net_pnl",
        F.when(F.col("open_price") > 0, F.col("net_pnl") / base).alias("pnl_ratio"), "holding_days",
        *[F.when(opt, parts[n]).alias(n) for n in ("underlying", "expiry", "option_type", "strike")],
        F.year("close_date").alias("close_year"), F.month("close_date").alias("close_month"),
        F.quarter("close_date").alias("close_quarter"))


def performance_rollup(perf: DataFrame, amount: str = "net_pnl") -> DataFrame:
    """Year, quarter and month subtotals in one pass."""
    won = F.when(F.col(amount) > 0, 1).otherwise(0)
    return perf.rollup("close_year", "close_quarter", "close_month").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("trades"),
        F.sum(won).alias("wins"), F.sum(amount).alias("total_pnl"))


def performance_by_kind(perf: DataFrame, amount: str = "net_pnl") -> DataFrame:
    """Subtotals by product, by instrument type and by both; ``level`` tells which column is summed over."""
    won = F.when(F.col(amount) > 0, 1).otherwise(0)
    kind = F.when(F.col("is_option") == 1, F.col("option_type")).otherwise("future")
    rows = perf.withColumn("product", S.product_code("instrument")).withColumn("kind", kind)
    return rows.groupingSets([["product", "kind"], ["product"], ["kind"]], "product", "kind").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("trades"), F.sum(won).alias("wins"),
        F.sum(amount).alias("total_pnl"))


def matched_stats(matched: DataFrame, top: int | None = None) -> DataFrame:
    """Totals per instrument; ``top`` keeps the most traded ones for a report."""
    rows = matched.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("money_pnl").alias("money_pnl"),
        F.sum("commission").alias("commission"), F.sum("net_pnl").alias("net_pnl"))
    return rows if top is None else rows.orderBy(F.desc("trades"), "instrument").limit(top)


def matched_totals(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("trades"), F.sum("money_pnl").alias("money_pnl"),
                       F.sum("commission").alias("commission"), F.sum("net_pnl").alias("net_pnl"))


def matched_trade_ids(matched: DataFrame) -> DataFrame:
    return matched.select(F.col("open_trade_id").alias("id")) \
        .union(matched.select(F.col("close_trade_id").alias("id"))).distinct()


def unmatched_trades(trades: DataFrame, matched: DataFrame) -> DataFrame:
    return trades.join(matched_trade_ids(matched), "id", "left_anti")


def match_audit(trades: DataFrame, matched: DataFrame) -> DataFrame:
    """Trades whose matched volume differs from their own, and closes used more than once."""
    legs = matched.select(F.col("open_trade_id").alias("id"), F.lit("open").alias("leg"),
                          F.col("open_volume").alias("v")) \
        .unionByName(matched.select(F.col("close_trade_id").alias("id"), F.lit("close").alias("leg"),
                                    F.col("close_volume").alias("v")))
    used = legs.groupBy("id", "leg").agg(F.sum("v").alias("matched_volume"),
                                         F.count(F.lit(1)).alias("uses"))
    out = used.join(trades.select("id", "volume"), "id")
    gap = F.abs(F.col("volume") - F.col("matched_volume")) > 0.01
    return out.withColumn("volume_mismatch", gap).withColumn("multi_use", F.col("uses") > 1) \
              .filter(F.col("volume_mismatch") | F.col("multi_use"))


def hypothetical_close(matched: DataFrame, quotes: DataFrame, price: str = "settle") -> DataFrame:
    """Actual result against closing at the settlement of the closing day."""
    q = quotes.select(F.col("contract_code").alias("instrument"),
                      F.col("trade_date").alias("close_date"), F.col(price).alias("virtual_close_price"))
    diff = F.when(F.col("open_direction") == "long", F.col("virtual_close_price") - F.col("open_price")) \
            .otherwise(F.col("open_price") - F.col("virtual_close_price"))
    virtual = diff * F.col("open_volume") * F.col("multiplier")
    return matched.join(q, ["instrument", "close_date"]) \
        .withColumn("virtual_money_pnl", virtual) \
        .withColumn("virtual_net_pnl", F.col("virtual_money_pnl") - F.col("commission")) \
        .withColumn("pnl_difference", F.col("net_pnl") - F.col("virtual_net_pnl"))


# ------------------------------------------------------------------ summaries

def pnl_summary(trades: DataFrame, keys: list[str] | None = None, pnl: str = "total_pnl",
                fee: str = "commission") -> DataFrame:
    n = F.count(F.lit(1))
    p = F.sum(F.coalesce(F.col(pnl), F.lit(0)))
    return trades.groupBy(*(keys or [])).agg(
        n.alias("trade_count"), p.alias("total_pnl"),
        F.sum(F.coalesce(F.col(fee), F.lit(0))).alias("total_fees"),
        (p.cast("double") / n).alias("avg_pnl_per_trade"))


def monthly_account_summary(bills: DataFrame, tie: str = "id") -> DataFrame:
    """Monthly roll-up of statements with a running P&L per account."""
    def z(c):
        return F.coalesce(F.col(c), F.lit(0))

    first = F.struct("bill_date_start", tie)
    monthly = bills.groupBy("account_id", F.year("bill_date_start").alias("year"),
                            F.month("bill_date_start").alias("month")).agg(
        F.min("bill_date_start").alias("start_date"), F.max("bill_date_end").alias("end_date"),
        F.count(F.lit(1)).alias("bill_count"),
        F.min_by("balance_bf", first).alias("balance_b_f"),
        F.max_by("balance_cf", first).alias("balance_c_f"),
        F.sum(z("deposit_withdrawal")).alias("deposit_withdrawal"),
        F.sum(z("realized_pl") + z("mtm_pl")).alias("total_pnl"),
        F.sum(z("exercise_pl")).alias("exercise_pnl"), F.sum(z("commission")).alias("commission"),
        F.sum(z("premium_received")).alias("premium_received"),
        F.sum(z("premium_paid")).alias("premium_paid"),
        F.max_by("client_equity", first).alias("client_equity"),
        F.max_by("fund_available", first).alias("fund_available"),
        F.max_by("margin_occupied", first).alias("margin_occupied"))
    # At most twelve rows per account and year, so this window is bounded.
    w = Window.partitionBy("account_id").orderBy("year", "month") \
              .rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn("accumulated_pnl", F.sum("total_pnl").over(w))


# Flow types of the fund-flow ledger.
FLOW_TYPES = ["deposit", "withdrawal", "realized_pnl", "unrealized_pnl", "commission",
              "premium_income", "premium_expense", "exercise_pnl"]


def _flow(df: DataFrame, rows: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Unfold flow candidates and keep the non-zero ones."""
    items = F.array(*[F.struct(kind.alias("flow_type"), amount.alias("amount"),
                               symbol.cast("string").alias("symbol")) for kind, amount, symbol in rows])
    return df.select("bill_id", "trade_date", F.inline(items)).filter(F.col("amount") != 0)


def fund_flows(deposits: DataFrame, transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """Signed ledger of one or many statements.

    deposits: bill_id, trade_date, deposit, withdrawal; transactions: bill_id, trade_date,
    instrument, fee, premium, realized_pl; statements: bill_id, bill_date_end, mtm_pl, exercise_pl.
    """
    none = F.lit(None)
    dep = _flow(deposits, [
        (F.lit("deposit"), F.when(F.col("deposit") > 0, F.col("deposit")), none),
        (F.lit("withdrawal"), F.when(F.col("withdrawal") > 0, -F.col("withdrawal")), none)])
    agg = transactions.groupBy("bill_id", "trade_date", "instrument").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("fee", "premium", "realized_pl")])
    sym = F.col("instrument")
    txn = _flow(agg, [
        (F.lit("commission"), -F.col("fee"), sym),
        (F.when(F.col("premium") > 0, F.lit("premium_income")).otherwise(F.lit("premium_expense")),
         F.col("premium"), sym),
        (F.lit("realized_pnl"), F.col("realized_pl"), sym)])
    whole = _flow(statements.withColumn("trade_date", F.col("bill_date_end")), [
        (F.lit("unrealized_pnl"), F.col("mtm_pl"), none),
        (F.lit("exercise_pnl"), F.col("exercise_pl"), none)])
    return dep.unionByName(txn).unionByName(whole)


def flow_identity(flows: DataFrame, bills: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Sum of flows against closing minus opening balance per statement."""
    s = flows.groupBy("bill_id").agg(F.sum("amount").alias("flow_total"))
    change = F.col("balance_cf") - F.col("balance_bf")
    return bills.select(F.col("id").alias("bill_id"), change.alias("balance_change")) \
        .join(s, "bill_id", "left") \
        .withColumn("flow_total", F.coalesce("flow_total", F.lit(0))) \
        .withColumn("balanced", F.abs(F.col("balance_change") - F.col("flow_total")) <= tolerance)


def flow_breakdown(flows: DataFrame) -> DataFrame:
    return flows.groupBy("bill_id", "flow_type").agg(F.sum("amount").alias("amount"),
                                                     F.count(F.lit(1)).alias("entries"))


# ------------------------------------------------------------------ reconciliation

def reconcile_trades(trades: DataFrame, quotes: DataFrame, tolerance_pct: float = 5.0) -> DataFrame:
    """Execution price against vwap, else settlement, else close of the day.

    Buys alert only when dearer than the tolerance, sells alert in both directions.
    """
    def nz(c):
        return F.nullif(F.col(c).cast("double"), F.lit(0.0)) if c in quotes.columns \
            else F.lit(None).cast("double")

    q = quotes.select("contract_code", "trade_date", "high", "low",
                      F.coalesce(nz("vwap"), nz("settle"), nz("close")).alias("_ref"),
                      F.lit(True).alias("_found"))
    j = trades.join(q, ["contract_code", "trade_date"], "left")
    slip = F.col("price") - F.col("_ref")
    pct = slip / F.col("_ref") * 100
    alert = F.when(F.col("direction") == "buy", pct > tolerance_pct) \
             .otherwise(F.abs(pct) > tolerance_pct)
    usable = F.col("_ref").isNotNull()
    status = F.when(F.col("_found").isNull(), "no_quote").when(~usable, "no_ref_price") \
              .when(alert, "alert").otherwise("ok")
    inside = F.col("price").between(F.coalesce("low", F.lit(0.0)),
                                    F.coalesce("high", F.lit(float("inf"))))
    return j.withColumns({
        "status": status, "ref_price": F.round("_ref", 2), "slippage": F.round(slip, 2),
        "slippage_pct": F.round(pct, 4), "in_range": F.when(usable, inside)}).drop("_ref", "_found")


def slippage_report(reconciled: DataFrame, keys: list[str] | None = None,
                    tie: str = "id") -> DataFrame:
    """Totals, alert count, mean and worst absolute slippage with the trade that caused it."""
    pct = F.abs("slippage_pct")
    n = F.count("slippage_pct")
    return reconciled.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_trades"), n.alias("matched_quotes"),
        F.count_if(F.col("status") == "no_quote").alias("no_quotes"),
        F.count_if(F.col("status") == "alert").alias("alert_count"),
        F.round(F.coalesce(F.sum(pct.cast("decimal(20,4)")).cast("double") / F.nullif(n, F.lit(0)),
                           F.lit(0.0)), 4).alias("avg_slippage_pct"),
        F.coalesce(F.max(pct), F.lit(0.0)).alias("max_slippage_pct"),
        F.max_by(tie, F.when(pct.isNotNull(), F.struct(pct, F.col(tie)))).alias("max_slippage_trade"))


# English and statement names of the balance fields, first present wins.
BALANCE_ALIASES = {
    "balance_opening": ["balance_opening", "期初权益", "期初客户权益"],
    "balance_closing": ["balance_closing", "期末权益", "期末客户权益"],
    "deposits": ["deposits", "入金", "本期入金"],
    "withdrawals": ["withdrawals", "出金", "本期出金"],
    "realized_pnl": ["realized_pnl", "平仓盈亏", "平盈"],
    "floating_pnl": ["floating_pnl", "持仓盈亏", "浮动盈亏", "盯市盈亏"],
    "commission": ["commission", "手续费", "成交手续费"],
    "delivery_pnl": ["delivery_pnl", "交割盈亏"],
    "other_adjustments": ["other_adjustments", "其他调整", "其他"],
}


def balance_check(statements: DataFrame, tolerance: float = 0.01, suspicious: float = 100.0) -> DataFrame:
    """Expected closing balance, discrepancy and status; accepts any alias column names."""
    def pick(name):
        present = [F.col(f"`{c}`").try_cast("decimal(20,4)") for c in BALANCE_ALIASES[name]
                   if c in statements.columns]
        return F.coalesce(*present, F.lit(0).cast("decimal(20,4)"))

    expected = (pick("balance_opening") + pick("deposits") - pick("withdrawals")
                + pick("realized_pnl") + pick("floating_pnl") - pick("commission")
                + pick("delivery_pnl") + pick("other_adjustments"))
    gap = F.abs(expected - pick("balance_closing"))
    return statements.withColumns({
        "expected_closing": expected.cast("decimal(20,2)"), "discrepancy": gap.cast("decimal(20,2)"),
        "balance_status": F.when(gap <= tolerance, "balanced")
                           .when(gap <= suspicious, "suspicious").otherwise("unbalanced")})


def fund_balance_rows(summary: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Balance equation per account period: pass, warn (within 5 %), fail."""
    def z(c):
        return F.coalesce(F.col(c), F.lit(0))

    expected = (F.col("balance_b_f") + z("deposit_withdrawal") + z("total_pnl") - z("commission")
                + z("premium_received") - z("premium_paid"))
    gap = F.abs(F.col("balance_c_f") - expected)
    verdict = F.when((F.col("balance_c_f") == 0) | (gap < tolerance), "pass") \
               .when(gap < F.col("balance_c_f") * 0.05, "warn").otherwise("fail")
    return summary.filter(F.col("balance_b_f").isNotNull()) \
        .withColumn("expected_cf", expected).withColumn("verdict", verdict)


def missing_statements(accounts: DataFrame, bills: DataFrame, resolved_calendar: DataFrame,
                       upto, last_days: int | None = None) -> DataFrame:
    """Trading days since tracking began with no statement.

    accounts: account_id, tracking_start. ``last_days`` limits to the latest trading days.
    """
    days = resolved_calendar.filter(F.col("is_trading") & (F.col("trade_date") <= F.lit(upto).cast("date")))
    if last_days:
        newest = days.agg(F.max("td_index")).scalar()
        days = days.filter(F.col("td_index") > newest - last_days)
    spans = accounts.filter(F.col("tracking_start") <= F.lit(upto).cast("date")).select(
        "account_id", F.explode(F.sequence("tracking_start", F.lit(upto).cast("date"),
                                           F.expr("interval 1 day"))).alias("trade_date"))
    expected = spans.join(F.broadcast(days.select("trade_date")), "trade_date", "left_semi")
    have = bills.select("account_id", F.col("bill_date_end").alias("trade_date"))
    return expected.join(have, ["account_id", "trade_date"], "left_anti")


# ------------------------------------------------------------------ strategies

def equity_curve(daily_pnl: DataFrame, key: str, capital: float, date: str = "trade_date",
                 pnl: str = "daily_pnl") -> DataFrame:
    """Running equity, return and drawdown per strategy; one row per strategy and day."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = daily_pnl.withColumn("total_equity", F.lit(capital) + F.sum(pnl).over(w))
    prev = F.coalesce(F.lag("total_equity").over(Window.partitionBy(key).orderBy(date)), F.lit(capital))
    out = out.withColumn("daily_return", F.col(pnl).cast("double") / prev.cast("double")) \
             .withColumn("cumulative_return", F.col("total_equity").cast("double") / F.lit(float(capital)) - 1)
    peak = F.greatest(F.max("total_equity").over(w), F.lit(capital))
    return out.withColumn("drawdown", 1 - F.col("total_equity").cast("double") / peak.cast("double"))


def strategy_stats(trades: DataFrame, curve: DataFrame, key: str, pnl: str = "net_pnl") -> DataFrame:
    """Trades, wins, win rate, profit factor, holding time, worst drawdown and Sharpe ratio."""
    p = F.col(pnl)
    t = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(p > 0).alias("win_trades"),
        F.count_if(p <= 0).alias("loss_trades"), F.sum(p).alias("total_pnl"),
        (F.sum(p).cast("double") / F.count(F.lit(1))).alias("avg_pnl"),
        (F.sum(F.when(p > 0, p)).cast("double")
         / F.nullif(F.abs(F.sum(F.when(p < 0, p))).cast("double"), F.lit(0.0))).alias("profit_factor"),
        F.avg("holding_days").alias("avg_holding_days"))
    c = curve.groupBy(key).agg(
        F.max("drawdown").alias("max_drawdown"),
        (F.avg("daily_return") / F.nullif(F.stddev_samp("daily_return"), F.lit(0.0))
         * F.sqrt(F.lit(252.0))).alias("sharpe_ratio"))
    return t.join(c, key, "left").withColumn(
        "win_rate", F.col("win_trades") / F.col("total_trades"))
