"""Broker settlement statements: one text file in, five relations out.

The job is file-parallel: a statement (one account, one period) is decoded as one row, its sections
are cut out by title, and the table lines are exploded into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.sources.text_files import read_texts

# Wording of the account-summary fields, as regular expressions.
SUMMARY_FIELDS = {
    "balance_bf": r"期初结存\s*Balance\s*B/F",
    "deposit_withdrawal": r"出\s*入\s*金\s*Deposit/Withdrawal",
    "realized_pl": r"平仓盈亏\s*Realized\s*P/L",
    "mtm_pl": r"持仓盯市盈亏\s*MTM\s*P/L",
    "exercise_pl": r"期权执行盈亏\s*Exercise\s*P/L",
    "commission": r"手\s*续\s*费\s*Commission",
    "exercise_fee": r"行权手续费\s*Exercise\s*Fee",
    "delivery_fee": r"交割手续费\s*Delivery\s*Fee",
    "fx_pledge_in": r"货币质入\s*New\s*FX\s*Pledge",
    "fx_pledge_out": r"货币质出\s*FX\s*Redemption",
    "pledge_change": r"质押变化金额\s*Chg\s*in\s*Pledge\s*Amt",
    "premium_received": r"权利金收入\s*Premium\s*Received",
    "premium_paid": r"权利金支出\s*Premium\s*Paid",
    "delivery_pl": r"交割盈亏\s*Delivery\s*P/L",
    "balance_cf": r"期末结存\s*Balance\s*C/F",
    "client_equity": r"客户权益\s*Client\s*Equity",
    "margin_occupied": r"保证金占用\s*Margin\s*Occupied",
    "fund_available": r"可用资金\s*Fund\s*Avail\.?",
    "risk_degree": r"风\s*险\s*度\s*Risk\s*Degree",
}
# Section titles.
SECTION_TITLES = {
    "deposits": r"出入金明细\s+Deposit/Withdrawal",
    "transactions": r"成交记录\s+Transaction\s+Record",
    "closed": r"平仓明细\s+Positions?\s+Closed",
    "positions": r"(?:持仓明细\s+Positions\s+Detail|持仓记录\s+Position\s+Record)",
    "summary": r"持仓汇总\s+Positions",
}
# Columns of each table in printed order.
TRANSACTION_COLUMNS = ["trade_date", "invest_unit", "exchange", "trading_code", "product", "instrument",
                       "direction", "hedge_type", "price", "volume", "turnover", "open_close", "fee",
                       "realized_pl", "premium", "trans_no", "account_id"]
CLOSED_COLUMNS = ["close_date", "invest_unit", "exchange", "trading_code", "product", "instrument",
                  "open_date", "hedge_type", "direction", "volume", "open_price", "prev_settle",
                  "close_price", "realized_pl", "premium", "account_id"]
POSITION_COLUMNS = ["invest_unit", "exchange", "trading_code", "product", "instrument", "open_date",
                    "hedge_type", "direction", "position", "open_price", "prev_settle", "settle",
                    "float_pl", "mtm_pl", "margin", "option_value", "account_id"]
DEPOSIT_COLUMNS = ["trade_date", "type", "deposit", "withdrawal", "exchange_rate", "account_id", "note"]

NUMBERS = {"price", "turnover", "fee", "realized_pl", "premium", "open_price", "prev_settle", "close_price",
           "settle", "float_pl", "mtm_pl", "margin", "option_value", "deposit", "withdrawal"}
INTEGERS = {"volume", "position"}
DATES = {"trade_date", "close_date", "open_date"}


def read_statements(spark: SparkSession, path, pattern: str | None = "*.txt") -> DataFrame:
    return read_texts(spark, path, pattern)


def _extract(pattern: str) -> Column:
    hit = F.regexp_extract("text", pattern, 1)
    return F.when(hit != "", F.trim(hit))


def _built(texts: DataFrame) -> DataFrame:
    """``texts(file, text)`` behind a generator of one row. Without it Spark puts the expression of a
    derived text into every filter and pattern, and builds the text again for each of them."""
    return texts.select("file", F.explode(F.array("text")).alias("text"))


def summaries(texts: DataFrame) -> DataFrame:
    """Account summary per file; files without a client id or date yield no row."""
    start = _extract(r"(?<!\S)日期\s*Date[：:]\s*(\d{8})")
    end = _extract(r"(?<!\S)日期\s*Date[：:]\s*\d{8}-(\d{8})")
    client = _extract(r"客户号\s*Client\s*ID[：:]\s*(\S+)")
    account = _extract(r"资金账号[：:]\s*(\d+)")
    # The filter looks at the results of the patterns, which are a generator's for the same reason.
    found = _built(texts).select("file", "text", F.inline(F.array(F.struct(
        client.alias("client_id"), account.alias("_account"), start.alias("_start"), end.alias("_end")))))
    money = [F.coalesce(S.clean_number(F.regexp_extract("text", p + r"[：:]\s*(-?[\d,]+\.?\d*)", 1), None), F.lit(0.0)).alias(n)
             for n, p in SUMMARY_FIELDS.items()]
    day = S.normalize_date("_start")
    return found.filter(F.col("client_id").isNotNull() & day.isNotNull()).select(
        "file", "client_id",
        _extract(r"客户名称\s*Client\s*Name[：:][ \t]*([^\n]+?)(?:[ \t]{2,}|[ \t]*日期|[ \t]*\n|[ \t]*$)").alias("client_name"),
        F.coalesce("_account", "client_id").alias("account_id"), F.lit("CNY").alias("currency"),
        day.alias("bill_date_start"), S.normalize_date(F.coalesce("_end", "_start")).alias("bill_date_end"), *money)


def _section(name: str) -> Column:
    """Text between a section title and its count line, the next title or the end of the file."""
    stops = "|".join([r"\|?\s*共\s*\d+\s*条", *[t for k, t in SECTION_TITLES.items() if k != name], r"\z"])
    return F.regexp_extract("text", rf"(?s)(?:^|\n)[ \t]*{SECTION_TITLES[name]}[ \t]*\n(.*?)(?:{stops})", 1)


def _split_row(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def _lines(texts: DataFrame, section: str) -> DataFrame:
    """``file, lines``: the pipe rows of a section, without rulings; null where there is no text."""
    lines = F.filter(F.split(_section(section), "\n"), lambda x: F.ltrim(x).startswith("|") & ~x.contains("---"))
    return _built(texts).select("file", F.explode(F.array(lines)).alias("lines"))


def _table(texts: DataFrame, section: str) -> DataFrame:
    """Pipe rows of a section as (file, cells); header rows are kept out later."""
    return _lines(texts, section).select("file", F.posexplode("lines").alias("row_no", "line")) \
                                 .select("file", "row_no", _split_row(F.col("line")).alias("cells"))


def _typed(columns: list[str]) -> list[Column]:
    out = []
    for i, name in enumerate(columns):
        cell = F.get("cells", F.lit(i))
        if name in DATES:
            cell = S.normalize_date(cell)
        elif name in NUMBERS:
            cell = S.clean_number(cell)
        elif name in INTEGERS:
            cell = S.clean_number(cell, 0, "bigint")
        elif name == "exchange_rate":
            cell = S.clean_number(cell, None)
        else:
            cell = F.coalesce(cell, F.lit(""))
        out.append(cell.alias(name))
    return out


def _is_date(i: int, cells: Column | str = "cells") -> Column:
    return F.coalesce(F.get(cells, F.lit(i)).rlike(r"^\d{8}"), F.lit(False))


def transactions(texts: DataFrame) -> DataFrame:
    """Executed trades, with the optional time and order-type columns of newer files, which the
    header rows of the same text name."""
    def spot(test) -> Column:
        at = F.transform("_heads", lambda row: F.array_position(F.transform(row, lambda c: test(F.lower(c))), F.lit(True)))
        return F.array_max(at)

    rows = _lines(texts, "transactions").select("file", F.explode(F.array(F.transform("lines", _split_row))).alias("_rows")) \
        .withColumn("_heads", F.filter("_rows", lambda row: ~_is_date(0, row)))
    spots = rows.select("file", "_rows", spot(lambda h: h.contains("time") & ~h.contains("date")).alias("_time_at"),
                        spot(lambda h: h.contains("委托") | (h.contains("order") & h.contains("type"))).alias("_type_at"))
    data = spots.select("file", "_time_at", "_type_at", F.posexplode("_rows").alias("row_no", "cells")) \
                .filter(_is_date(0) & (F.size("cells") >= 15))
    at = F.get("cells", (F.coalesce("_time_at", F.lit(0)) - 1).cast("int"))
    kind = F.get("cells", (F.coalesce("_type_at", F.lit(0)) - 1).cast("int"))
    return data.select(
        "file", "row_no", *_typed(TRANSACTION_COLUMNS),
        F.when((F.col("_time_at") > 0) & at.rlike(r"^\d{2}:\d{2}:\d{2}"), at).alias("trade_time"),
        F.when((F.col("_type_at") > 0) & (kind != ""), kind).alias("order_type")) \
        .withColumn("instrument_type", S.instrument_type("instrument")) \
        .withColumn("option_type", S.option_side("instrument"))


def deposits(texts: DataFrame) -> DataFrame:
    return _table(texts, "deposits").filter(_is_date(0) & (F.size("cells") >= 4)) \
        .select("file", "row_no", *_typed(DEPOSIT_COLUMNS))


def positions(texts: DataFrame) -> DataFrame:
    """Open positions by open date; header rows have no date in the open-date column."""
    return _table(texts, "positions").filter(_is_date(5) & (F.size("cells") >= 15)) \
        .select("file", "row_no", *_typed(POSITION_COLUMNS)) \
        .withColumn("instrument_type", S.instrument_type("instrument"))


def closed_positions(texts: DataFrame) -> DataFrame:
    return _table(texts, "closed").filter(_is_date(0) & (F.size("cells") >= 14)) \
        .select("file", "row_no", *_typed(CLOSED_COLUMNS))


def to_trades(txns: DataFrame) -> DataFrame:
    """Transactions with canonical direction and offset codes, in the layout of the trades table."""
    return txns.select(
        "file", "row_no", "account_id", "trade_date", "exchange", "product", "instrument",
        S.map_code("direction", S.DIRECTION_CODES).alias("direction"),
        S.map_code("open_close", S.OFFSET_CODES).alias("offset_flag"), "volume", "price", "turnover",
        F.col("fee").alias("commission"), F.col("realized_pl").alias("total_pnl"), "premium",
        F.col("trans_no").alias("trade_id"))


def to_position_summary(pos: DataFrame) -> DataFrame:
    long, short = S.long_short_columns("direction", "position")
    return pos.select("file", "account_id", "instrument", "exchange", "product",
                      long.cast("bigint").alias("long_position"), short.cast("bigint").alias("short_position"),
                      F.col("prev_settle").alias("prev_settlement"), F.col("settle").alias("settlement_price"),
                      F.col("margin").alias("margin_occupied"), "float_pl")


def parse(spark: SparkSession, path, pattern: str | None = "*.txt") -> dict[str, DataFrame]:
    return parse_texts(read_statements(spark, path, pattern))


def parse_texts(texts: DataFrame) -> dict[str, DataFrame]:
    """All relations of ``texts(file, text)``."""
    return {"files": texts.select("file"), "summaries": summaries(texts), "transactions": transactions(texts),
            "deposits": deposits(texts), "positions": positions(texts), "closed": closed_positions(texts)}
