"""Text files: statements and exchange CSV files rendered from the tables by Spark and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import quality as qa
from tickloom.plans.registry import query
from tickloom.session import shared_dir
from tickloom.sources import csv_quotes, statements

LABELS = {"balance_bf": "期初结存 Balance B/F", "deposit_withdrawal": "出 入 金 Deposit/Withdrawal", "realized_pl": "平仓盈亏 Realized P/L",
          "mtm_pl": "持仓盯市盈亏 MTM P/L", "exercise_pl": "期权执行盈亏 Exercise P/L", "commission": "手 续 费 Commission",
          "premium_received": "权利金收入 Premium Received", "premium_paid": "权利金支出 Premium Paid", "balance_cf": "期末结存 Balance C/F",
          "client_equity": "客户权益 Client Equity", "margin_occupied": "保证金占用 Margin Occupied", "fund_available": "可用资金 Fund Avail."}


def _money(c) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 2)


def _bars(*cells) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells]), F.lit("|"))


def _table(title: str, columns: list[str], rows: str) -> Column:
    """A table of a statement; empty ones say so."""
    head = F.lit(f"\n  {title}\n|{'|'.join(columns)}|\n------\n")
    return F.concat(head, F.concat_ws("\n", F.col(rows)), F.lit("\n"), F.lit("共 "), F.size(rows).cast("string"), F.lit(" 条\n"))


def statement_texts(f) -> DataFrame:
    """One statement per account and day: every order of the day is a transaction, filled orders
    are closed positions, open ones are held."""
    o = f.table("orders").select("*", F.to_date("o_orderdate").alias("d"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
                                 F.col("o_totalprice").cast("decimal(18,2)").alias("m"))
    key, price, day, account = F.col("o_orderkey"), _money("m"), F.col("day"), F.col("o_custkey")
    ins = F.when(key % 3 == 0, "IC2406").when(key % 3 == 1, F.concat(F.lit("MO2406-C-"), (key % 40 * 50 + 5000).cast("string"))).otherwise("rb2410")
    lots, side = key % 9 + 1, F.when(key % 2 == 0, "买").otherwise("卖")
    filled, held = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    own = ("-", "虚构所", "X1", "品种")
    deal = _bars(day, *own, ins, side, "投", price, lots, _money(F.col("m") * lots), F.when(filled, "平").otherwise("开"), "5.00",
                 F.when(filled, price).otherwise("0.00"), F.when(key % 3 == 1, F.concat(F.lit("-"), price)).otherwise("0.00"),
                 F.concat(F.lit("T"), key.cast("string")), account, "10:15:20")
    closed = _bars(day, *own, ins, day, "投", side, lots, price, price, price, "0.00", "0.00", account)
    open_ = _bars(*own, ins, day, "投", side, lots, price, price, price, "-1.25", "0.00", price, "0.00", account)

    def listed(row: Column, when: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("o_orderkey", row.alias("t"))))), lambda r: r["t"])

    tables = o.groupBy(F.concat(F.lit("C"), account.cast("string")).alias("account_id"), F.col("d").alias("bill_date_start"), "day").agg(
        listed(deal, F.lit(True)).alias("deals"), listed(closed, filled).alias("closed"), listed(open_, held).alias("held"))
    b = f.bills.join(tables, ["account_id", "bill_date_start"])
    number = F.substring("account_id", 2, 20)
    paid = F.when(F.col("deposit_withdrawal") > 0, F.array(_bars(F.col("day"), "转账", _money("deposit_withdrawal"), "0.00", "1", number, "存"))) \
            .otherwise(F.array().cast("array<string>"))
    lines = [F.concat(F.lit(f"{label}："), _money(c)) for c, label in LABELS.items()]
    text = F.concat(
        F.lit("客户号 Client ID："), F.col("account_id"), F.lit("   客户名称 Client Name：虚构账户\n日期 Date："), F.col("day"),
        F.lit("\n资金账号："), number, F.lit("\n\n"), F.concat_ws("\n", *lines), F.lit("\n"),
        _table("出入金明细 Deposit/Withdrawal", statements.DEPOSIT_COLUMNS, "paid"),
        _table("成交记录 Transaction Record", [*statements.TRANSACTION_COLUMNS, "Trade Time"], "deals"),
        _table("平仓明细 Position Closed", statements.CLOSED_COLUMNS, "closed"),
        _table("持仓明细 Positions Detail", statements.POSITION_COLUMNS, "held"))
    return b.withColumn("paid", paid).select(F.concat(F.lit("b"), F.col("id").cast("string"), F.lit(".txt")).alias("file"), text.alias("text"))


ORDERS = """
SELECT 'b' || CAST(o_custkey * 100000 + date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) || '.txt' AS file, CAST(o_orderdate AS DATE) AS d,
       CASE o_orderkey % 3 WHEN 0 THEN 'IC2406' WHEN 1 THEN 'MO2406-C-' || (o_orderkey % 40 * 50 + 5000) ELSE 'rb2410' END AS instrument,
       CASE WHEN o_orderkey % 2 = 0 THEN '买' ELSE '卖' END AS direction, o_orderkey % 9 + 1 AS lots, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, * FROM orders"""


@query("statement_summaries", "A06", f"""
SELECT 'b' || id || '.txt' AS file, account_id AS client_id, '虚构账户' AS client_name, substr(account_id, 2) AS account_id, bill_date_start, bill_date_end,
       {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LABELS)} FROM bills""")
def statement_summaries(f):
    return statements.summaries(statement_texts(f)).select("file", "client_id", "client_name", "account_id", "bill_date_start", "bill_date_end", *LABELS)


@query("statement_transactions", "A07", f"""
SELECT file, d AS trade_date, instrument, direction, price, lots AS volume, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * lots AS DOUBLE) AS turnover,
       CASE WHEN o_orderstatus = 'F' THEN '平' ELSE '开' END AS open_close, 5e0 AS fee, CASE WHEN o_orderstatus = 'F' THEN price ELSE 0 END AS realized_pl,
       CASE WHEN o_orderkey % 3 = 1 THEN -price ELSE 0 END AS premium, 'T' || o_orderkey AS trans_no, CAST(o_custkey AS VARCHAR) AS account_id, '10:15:20' AS trade_time,
       CASE WHEN o_orderkey % 3 = 1 THEN 'option' ELSE 'future' END AS instrument_type, CASE WHEN o_orderkey % 3 = 1 THEN 'C' END AS option_type FROM ({ORDERS}) x""")
def statement_transactions(f):
    return statements.transactions(statement_texts(f)).select(
        "file", "trade_date", "instrument", "direction", "price", "volume", "turnover", "open_close", "fee", "realized_pl", "premium", "trans_no",
        "account_id", "trade_time", "instrument_type", "option_type")


@query("statement_deposits", "A08", """
SELECT 'b' || id || '.txt' AS file, bill_date_start AS trade_date, CAST(deposit_withdrawal AS DOUBLE) AS deposit, 0e0 AS withdrawal, 1e0 AS exchange_rate,
       substr(account_id, 2) AS account_id, '存' AS note FROM bills WHERE deposit_withdrawal > 0""")
def statement_deposits(f):
    return statements.deposits(statement_texts(f)).select("file", "trade_date", "deposit", "withdrawal", "exchange_rate", "account_id", "note")


@query("statement_positions", "A09", f"""
SELECT file, d AS open_date, instrument, direction, lots AS position, price AS open_price, price AS prev_settle, price AS settle, -1.25e0 AS float_pl, price AS margin,
       CAST(o_custkey AS VARCHAR) AS account_id FROM ({ORDERS}) x WHERE o_orderstatus = 'O'""")
def statement_positions(f):
    return statements.positions(statement_texts(f)).select("file", "open_date", "instrument", "direction", "position", "open_price", "prev_settle",
                                                           "settle", "float_pl", "margin", "account_id")


@query("statement_closed_positions", "A10", f"""
SELECT file, d AS close_date, d AS open_date, instrument, direction, lots AS volume, price AS open_price, price AS close_price, CAST(o_custkey AS VARCHAR) AS account_id
FROM ({ORDERS}) x WHERE o_orderstatus = 'F'""")
def statement_closed(f):
    return statements.closed_positions(statement_texts(f)).select("file", "close_date", "open_date", "instrument", "direction", "volume", "open_price",
                                                                  "close_price", "account_id")


@query("statement_audit", "L21", f"""
SELECT file, true AS parsed, cf = 0 OR abs(cf - (bf + dep + rea + mtm - com)) <= abs(cf) * 0.05 AS balance_ok, n AS trades
FROM (SELECT 'b' || id || '.txt' AS file, CAST(balance_bf AS DOUBLE) AS bf, CAST(balance_cf AS DOUBLE) AS cf, CAST(deposit_withdrawal AS DOUBLE) AS dep,
             CAST(realized_pl AS DOUBLE) AS rea, CAST(mtm_pl AS DOUBLE) AS mtm, CAST(commission AS DOUBLE) AS com FROM bills) b
JOIN (SELECT file, count(*) AS n FROM ({ORDERS}) x GROUP BY file) c USING (file)""")
def statement_audit(f):
    p = statements.parse_texts(statement_texts(f))
    return qa.parsed_statement_audit(p["files"], p["summaries"], p["transactions"])


# ------------------------------------------------------------------ exchange CSV files

#: Lines that one text may hold.
TEXT_LINES = 1000


def _file(rows: DataFrame, name: Column, header: Column, line: Column, by: list[str], number: Column) -> DataFrame:
    """CSV texts: the header, then the lines in the order of their ``number``, from 1 within ``by``.

    A file of more lines comes in several texts of its name, each with the header, so that no row
    grows with the file.
    """
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_number").alias("o"), line.alias("t")))), lambda r: r["t"])
    cut = rows.withColumn("_number", number).withColumn("_part", F.floor((F.col("_number") - 1) / TEXT_LINES))
    return cut.groupBy(*by, "_part").agg(lines.alias("_lines"), F.first(header).alias("_head")).select(
        name.alias("file"), F.concat_ws("\n", F.col("_head"), F.col("_lines")).alias("text"))


def quote_texts(f) -> DataFrame:
    """One file per exchange and day; files of EX1 carry 44 more columns before the last two."""
    q = f.daily_quotes
    wide = F.col("exchange") == "EX1"
    names = ["合约代码", "开盘价", "最高价", "最低价", "收盘价"]
    head = F.concat(F.lit(",".join(names)), F.when(wide, "," + ",".join(f"备注{i}" for i in range(44))).otherwise(""), F.lit(",成交量,结算价"))
    line = F.concat(F.concat_ws(",", "contract_code", F.concat(F.lit('"'), F.col("open").cast("string"), F.lit('"')), F.col("high").cast("string"),
                                F.col("low").cast("string"), F.col("close").cast("string")),
                    F.when(wide, "," * 44).otherwise(""), F.lit(","), F.col("volume").cast("string"), F.lit(","), F.col("settle").cast("string"))
    return _file(q, F.concat("exchange", F.lit("_"), F.date_format("trade_date", "yyyyMMdd"), F.lit(".csv")), head, line,
                 ["exchange", "trade_date"], F.row_number().over(Window.partitionBy("exchange", "trade_date").orderBy("contract_code")))


QUOTES_SQL = """
SELECT exchange || '_' || strftime(trade_date, '%Y%m%d') || '.csv' AS file, trade_date, contract_code AS instrument_id, open AS open_price, high AS high_price,
       low AS low_price, close AS close_price, settle AS settlement_price, CAST(volume AS DOUBLE) AS volume, '{}' AS data_type FROM daily_quotes"""
QUOTE_COLUMNS = ["file", "trade_date", "instrument_id", "open_price", "high_price", "low_price", "close_price", "settlement_price", "volume", "data_type"]


@query("csv_daily_quotes", "A01", QUOTES_SQL.format("daily"))
def csv_daily_quotes(f):
    return csv_quotes.parse_quotes(quote_texts(f)).select(*QUOTE_COLUMNS)


@query("csv_quotes_in_splits", "A01 A22", """
SELECT trade_date, contract_code AS instrument_id, open AS open_price, close AS close_price, CAST(volume AS DOUBLE) AS volume FROM daily_quotes""")
def csv_quotes_in_splits(f):
    """Files written by many tasks, each with a header line, read back in splits."""
    path = f"{shared_dir(f.spark)}/csv-{uuid.uuid4().hex}"
    f.daily_quotes.select(F.date_format("trade_date", "yyyy-MM-dd").alias("交易日"), F.col("contract_code").alias("合约代码"),
                          F.col("open").alias("开盘价"), F.col("close").alias("收盘价"), F.col("volume").alias("成交量")) \
        .write.option("header", "true").option("quoteAll", "true").csv(path)
    out = csv_quotes.read_large_quotes(f.spark, path)
    return out.select("trade_date", "instrument_id", "open_price", "close_price", "volume")


@query("csv_monthly_quotes", "A02", QUOTES_SQL.format("monthly"))
def csv_monthly_quotes(f):
    return csv_quotes.parse_quotes(quote_texts(f), data_type="monthly").select(*QUOTE_COLUMNS)


@query("csv_member_positions", "A03", """
SELECT strftime(trade_date, '%Y%m%d') || '.csv' AS file, trade_date, contract_code AS instrument_id, trim(member_name) AS member_name, CAST(long_volume AS DOUBLE) AS long_volume,
       CAST(short_volume AS DOUBLE) AS short_volume, CAST(long_volume - short_volume AS DOUBLE) AS net_position FROM positions""")
def csv_member_positions(f):
    line = F.concat_ws(",", F.date_format("trade_date", "yyyyMMdd"), "contract_code", "member_name", F.col("long_volume").cast("string"),
                       F.col("short_volume").cast("string"))
    texts = _file(f.positions, F.concat(F.date_format("trade_date", "yyyyMMdd"), F.lit(".csv")),
                  F.lit("交易日,合约代码,会员简称,多头持仓,空头持仓"), line, ["trade_date", "contract_code"], F.col("rank"))
    return csv_quotes.parse_positions(texts).select("file", "trade_date", "instrument_id", "member_name", "long_volume", "short_volume", "net_position")


@query("statement_fields", "L22", """
SELECT file, field, CAST(actual AS DOUBLE) AS actual, CASE WHEN actual <> 0 THEN 'PASS' ELSE 'WARN' END AS status
FROM (SELECT 'b' || id || '.txt' AS file, unnest(['balance_bf', 'balance_cf', 'client_equity']) AS field, unnest([balance_bf, balance_cf, client_equity]) AS actual FROM bills) b""")
def statement_fields(f):
    return qa.statement_field_presence(statements.summaries(statement_texts(f)))
