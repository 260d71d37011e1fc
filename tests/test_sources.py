"""Synthetic files only: names and numbers below are invented."""

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import quality as qa, trading
from tickloom.sources import csv_quotes, statements, tables, text_files

# Statement texts are rendered from the values below; only the field labels are the format's own.
LABELS = {  # label printed for each summary field that the invented statement carries
    "balance_bf": "期初结存 Balance B/F", "balance_cf": "期末结存  Balance  C/F", "deposit_withdrawal": "出 入 金 Deposit/Withdrawal",
    "realized_pl": "平仓盈亏 Realized P/L", "mtm_pl": "持仓盯市盈亏 MTM P/L", "commission": "手 续 费 Commission",
    "premium_received": "权利金收入 Premium Received", "premium_paid": "权利金支出 Premium Paid",
    "client_equity": "客户权益 Client Equity", "fund_available": "可用资金 Fund Avail.", "margin_occupied": "保证金占用 Margin Occupied"}
MONEY = {"balance_bf": 730_250.0, "balance_cf": 741_985.5, "deposit_withdrawal": 8_800.0, "realized_pl": 2_140.5, "mtm_pl": -905.0,
         "commission": 61.0, "premium_received": 4_410.0, "premium_paid": 2_649.0, "client_equity": 741_985.5,
         "fund_available": 655_002.25, "margin_occupied": 86_983.25}
OWNER, ACCOUNT = "77001", "90210007"
TITLES = {"deposits": "出入金明细 Deposit/Withdrawal", "transactions": "成交记录 Transaction Record",
          "closed": "平仓明细 Position Closed", "positions": "持仓明细 Positions Detail"}
EXTRA = {"transactions": ["Trade Time"]}


def render(days, tables=None):
    """A statement: the summary, then each table with a header row, a rule, its rows and their count."""
    out = [f"客户号 Client ID：{OWNER}   客户名称 Client Name：虚构账户", f"日期 Date：{days}", f"资金账号：{ACCOUNT}", ""]
    out += [f"{LABELS[k]}：{v:,.2f}" for k, v in MONEY.items()]
    columns = {"deposits": statements.DEPOSIT_COLUMNS, "transactions": statements.TRANSACTION_COLUMNS,
               "closed": statements.CLOSED_COLUMNS, "positions": statements.POSITION_COLUMNS}
    for name, rows in (tables or {"deposits": [], "transactions": []}).items():
        names = columns[name] + EXTRA.get(name, [])
        out += ["", f"    {TITLES[name]}", "|" + "|".join(names) + "|", "-" * 30]
        out += ["| " + " | ".join(map(str, r)) + " |" for r in rows]
        out += [f"|共 {len(rows)} 条|" if rows else f"共 {len(rows)} 条"]
    return "\n".join(out) + "\n"


def deal(day, ins, side, px, lots, what, fee, pl, premium, no, at):
    return [day, "-", "虚构所", "X9", "品种", ins, side, "投", px, lots, "0.00", what, fee, pl, premium, no, ACCOUNT, at]


EMPTY = render("20240311")
FULL = render("20240311-20240312", {
    "deposits": [["20240311", "转账", "9,300.00", "0.00", "1", ACCOUNT, "存"], ["20240312", "转账", "0.00", "500.00", "1", ACCOUNT, "取"]],
    "transactions": [
        deal("20240311", "IO2404-P-3500", "买", "88.3", 3, "开", "45.00", "0.00", "-2,649.00", "N7", "10:15:20"),
        deal("20240312", "IO2404-P-3500", "卖", "147.0", 3, "平", "12.00", "-", "4,410.00", "N8", "13:40:59"),
        deal("20240312", "hc2410", "买", "3,712", 4, "开", "4.00", "", "0.00", "N9", "soon")],
    "closed": [["20240312", "-", "虚构所", "X9", "品种", "IO2404-P-3500", "20240311", "投", "卖", 3, "88.3", "90.1", "147.0", "1,761.00", "4,410.00", ACCOUNT]],
    "positions": [["-", "虚构所", "X9", "品种", "hc2410", "20240312", "投", "买", 4, "3,712", "3,700", "3,689", "-92.00", "-92.00", "14,848.00", "0.00", ACCOUNT]]})


def write(path, name, text, encoding="utf-8"):
    (path / name).write_bytes(text.encode(encoding))


def test_statement_encodings_agree(spark, tmp_path):
    write(tmp_path, "a_utf8.txt", EMPTY)
    write(tmp_path, "b_gbk.txt", EMPTY, "gbk")
    write(tmp_path, "c_full.txt", FULL, "gbk")
    write(tmp_path, "d_bad.txt", "nothing here")
    p = statements.parse(spark, str(tmp_path))
    s = {r.file: r.asDict() for r in p["summaries"].collect()}
    a, b = (dict(s[n], file="") for n in ("a_utf8.txt", "b_gbk.txt"))
    assert a == b and "d_bad.txt" not in s
    assert (a["client_id"], a["account_id"], a["balance_bf"], a["fund_available"], a["margin_occupied"]) == (OWNER, ACCOUNT, 730_250.0, 655_002.25, 86_983.25)
    assert a["bill_date_start"] == a["bill_date_end"] and str(s["c_full.txt"]["bill_date_end"]) == "2024-03-12"
    assert a["client_name"] == "虚构账户" and a["risk_degree"] == 0.0
    for name in ("transactions", "deposits", "positions", "closed"):
        assert {r.file for r in p[name].select("file").distinct().collect()} == {"c_full.txt"}


def test_statement_tables(spark, tmp_path):
    write(tmp_path, "c.txt", FULL, "gbk")
    p = statements.parse(spark, str(tmp_path))
    t = p["transactions"].orderBy("row_no").collect()
    assert [(r.instrument, r.direction, r.price, r.volume, r.premium, r.trade_time) for r in t] == [
        ("IO2404-P-3500", "买", 88.3, 3, -2649.0, "10:15:20"), ("IO2404-P-3500", "卖", 147.0, 3, 4410.0, "13:40:59"),
        ("hc2410", "买", 3712.0, 4, 0.0, None)]
    assert [(r.instrument_type, r.option_type) for r in t][1:] == [("option", "P"), ("future", None)]
    d = p["deposits"].orderBy("row_no").collect()
    assert [(r.deposit, r.withdrawal, r.note) for r in d] == [(9300.0, 0.0, "存"), (0.0, 500.0, "取")]
    [pos] = p["positions"].collect()
    assert (pos.instrument, str(pos.open_date), pos.position, pos.open_price, pos.prev_settle, pos.settle, pos.margin) == (
        "hc2410", "2024-03-12", 4, 3712.0, 3700.0, 3689.0, 14848.0)
    [c] = p["closed"].collect()
    assert (c.open_price, c.close_price, c.realized_pl, str(c.open_date)) == (88.3, 147.0, 1761.0, "2024-03-11")
    tr = statements.to_trades(p["transactions"]).orderBy("row_no").collect()
    assert [(r.direction, r.offset_flag) for r in tr] == [("buy", "open"), ("sell", "close"), ("buy", "open")]
    [ps] = statements.to_position_summary(p["positions"]).collect()
    assert (ps.long_position, ps.short_position) == (4, 0)
    [audit] = qa.parsed_statement_audit(p["files"], p["summaries"], p["transactions"]).collect()
    assert (audit.parsed, audit.balance_ok, audit.trades) == (True, True, 3)
    assert {r.status for r in qa.statement_field_presence(p["summaries"]).collect()} == {"PASS"}


def test_statement_fund_flows(spark, tmp_path):
    write(tmp_path, "c.txt", FULL)
    p = statements.parse(spark, str(tmp_path))
    one = F.lit(1).alias("bill_id")
    fl = trading.fund_flows(p["deposits"].select(one, "trade_date", "deposit", "withdrawal"),
                            p["transactions"].select(one, "trade_date", "instrument", "fee", "premium", "realized_pl"),
                            p["summaries"].select(one, "bill_date_end", "mtm_pl", "exercise_pl")).collect()
    got = sorted((str(r.trade_date), r.flow_type, r.amount, r.symbol or "") for r in fl)
    option = "IO2404-P-3500"
    assert got == sorted([
        ("2024-03-11", "deposit", 9300.0, ""), ("2024-03-12", "withdrawal", -500.0, ""), ("2024-03-11", "commission", -45.0, option),
        ("2024-03-12", "commission", -12.0, option), ("2024-03-12", "commission", -4.0, "hc2410"),
        ("2024-03-11", "premium_expense", -2649.0, option), ("2024-03-12", "premium_income", 4410.0, option),
        ("2024-03-12", "unrealized_pnl", -905.0, "")])


def test_wide_files_and_unreadable_files(spark, tmp_path):
    """Cells beyond any fixed width count, four-byte GB18030 is read, and one bad file stops no other."""
    names = ["合约代码", *[f"备注{i}" for i in range(44)], "结算价", "成交量"]
    write(tmp_path, "20240311.csv", ",".join(names) + "\nIC2404," + "," * 44 + "5301.5,120\n", "gb18030")
    write(tmp_path, "20240312.csv", "合约代码,结算价,期权类型\nIC2405,5,\U00020087\"x\"\n", "gb18030")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xff\x80\x00\xfe")
    r = {x.instrument_id: x for x in csv_quotes.read_quotes(spark, str(tmp_path)).collect()}
    assert (r["IC2404"].settlement_price, r["IC2404"].volume) == (5301.5, 120.0)
    assert r["IC2405"].settlement_price == 5.0 and r["IC2405"].option_type.startswith("\U00020087")
    assert [x.file for x in text_files.unreadable_files(spark, str(tmp_path)).collect()] == ["bad.csv"]


def test_a_line_of_100000_quoted_cells(spark, tmp_path):
    cells = ",".join(f'"{i},x"' for i in range(100_000))
    write(tmp_path, "20240311.csv", "合约代码,结算价\nIC2404,5," + cells + "\nIC2405,6\n", "gb18030")
    got = {r.instrument_id: r.settlement_price for r in csv_quotes.read_quotes(spark, str(tmp_path)).collect()}
    assert got == {"IC2404": 5.0, "IC2405": 6.0}


def test_cells_of_a_line(spark):
    lines = ['a,"b,c",d', '"a ""q"" b",,x', 'un"balanced,1,2', ' "x" , y', '"', ",,", "", 'a,"b"c,d"e"']
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", csv_quotes._cells(F.col("line")).alias("c")).collect()

    def cells(line):
        out, cell, behind = [], "", line.count('"')
        for ch in line:
            behind -= ch == '"'
            if ch == "," and behind % 2 == 0:
                out, cell = [*out, cell], ""
            else:
                cell += ch
        bare = [c.strip() for c in [*out, cell]]
        bare = [c[1:-1].replace('""', '"').strip() if len(c) > 1 and c[0] == c[-1] == '"' else c for c in bare]
        return [c or None for c in bare]

    assert {r.line: r.c for r in got} == {x: cells(x) for x in lines}


def test_large_files_in_splits_give_the_same_rows(spark, tmp_path):
    """Files of both encodings cut every 300 bytes, with a repeated header, blank lines and a bad file."""
    head = "交易日,合约代码,开盘价,收盘价,期权类型"
    body = [f"2026-04-{1 + i % 28:02d},IF{i},{i}.5,{i * 2},看涨期权{chr(0x4e00 + i)}" for i in range(150)]
    write(tmp_path, "20260408.csv", "\n".join([head, *body[:40], "", head, *body[40:]]) + "\r\n", "gb18030")
    write(tmp_path, "b c.csv", "\ufeff\n" + head + "\n" + "\n".join(body[:70]), "utf-8")
    write(tmp_path, "20260410.csv", head, "utf-8")
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xff\x80\x00\xfe\nx,y\n")
    whole = sorted(map(str, csv_quotes.read_quotes(spark, str(tmp_path)).collect()))
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        large = csv_quotes.read_large_quotes(spark, str(tmp_path))
        assert text_files._raw_lines(spark, str(tmp_path), "*.csv").rdd.getNumPartitions() > 15
        assert sorted(map(str, large.collect())) == whole and len(whole) == 150 + 1 + 70
        assert [r.file for r in text_files.unreadable_line_files(spark, str(tmp_path)).collect()] == ["bad.csv"]
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_quote_csv_headers_encodings_and_dates(spark, tmp_path):
    write(tmp_path, "20260408_1.csv", "合约代码,今开盘,最高价,最低价,成交量,今收盘价,今结算\nMO2604,3500,3600,3400,1000,bad,3520\nMO2605,\"3,4\",1,2,3,4,5\n", "gbk")
    write(tmp_path, "x.csv", "交易日,合约代码,开盘价,收盘价\n2026-04-09,IF2604,1.5,2.5\n")
    write(tmp_path, "20260410.csv", "A,B,C,D,E,F,G,H,I,J,K,L,M,N\nMO2606,1,2,3,4,5,6,7,8,9,10,11,12,0.5\n")
    r = {x.instrument_id: x for x in csv_quotes.read_quotes(spark, str(tmp_path)).collect()}
    assert (str(r["MO2604"].trade_date), r["MO2604"].high_price, r["MO2604"].close_price, r["MO2604"].settlement_price) == ("2026-04-08", 3600.0, None, 3520.0)
    assert (str(r["IF2604"].trade_date), r["IF2604"].open_price, r["IF2604"].close_price) == ("2026-04-09", 1.5, 2.5)
    assert (str(r["MO2606"].trade_date), r["MO2606"].open_price, r["MO2606"].close_price, r["MO2606"].delta) == ("2026-04-10", 1.0, 9.0, 0.5)
    assert {x.data_type for x in csv_quotes.read_monthly(spark, str(tmp_path)).collect()} == {"monthly"}
    q = csv_quotes.to_daily_quotes(csv_quotes.read_quotes(spark, str(tmp_path)), "CFFEX")
    assert set(q.columns) == set(schemas.DAILY_QUOTES.fieldNames())


def test_position_csv_and_wide_ranking(spark, tmp_path):
    (tmp_path / "p").mkdir(), (tmp_path / "w").mkdir()
    write(tmp_path / "p", "20260408.csv", "交易日,合约代码,会员简称,多头持仓,空头持仓\n20260408,MO2604,甲,100,40\n20260408,MO2604,乙,50,70\n", "gbk")
    rows = csv_quotes.read_positions(spark, str(tmp_path / "p"))
    assert {r.member_name: r.net_position for r in rows.collect()} == {"甲": 60.0, "乙": -20.0}
    [s] = csv_quotes.position_file_stats(rows).collect()
    assert (s.member_count, s.instrument_count, s.total_long, s.total_short) == (2, 1, 150.0, 110.0)
    wide = "h\nh\nh\n20260515,MO2605,1,甲,76,-4,乙,60,-10,丙,5,1\n20260515,MO2605,2,丁,70,2,,0,0,戊,5,1\n"
    write(tmp_path / "w", "w.csv", wide, "gbk")
    sides = csv_quotes.read_wide_ranking(spark, str(tmp_path / "w")).collect()
    assert sorted((r.rank, r.side, r.member_name, r.volume, r.volume_change) for r in sides) == [(1, "long", "甲", 76, -4), (1, "short", "乙", 60, -10), (2, "long", "丁", 70, 2)]


def day_rows(spark, rows):
    return spark.createDataFrame(rows, "exchange string, contract_code string, d string, close double, seq int") \
        .select("exchange", "contract_code", F.col("d").cast("date").alias("trade_date"), "close", "seq")


def test_upsert_is_idempotent_and_touches_only_its_days(spark, tmp_path):
    path, keys = str(tmp_path / "t"), schemas.KEYS["daily_quotes"]
    tables.upsert(spark, day_rows(spark, [("X", "a", "2024-01-02", 1.0, 1), ("X", "b", "2024-01-02", 2.0, 1), ("X", "a", "2024-01-03", 3.0, 1)]), path, keys, ["seq"])
    batch = day_rows(spark, [("X", "a", "2024-01-03", 9.0, 2), ("X", "a", "2024-01-03", 8.0, 1), ("X", "c", "2024-01-03", 7.0, 1)])
    for _ in range(2):
        tables.upsert(spark, batch, path, keys, ["seq"])
        got = sorted((r.contract_code, str(r.trade_date), r.close) for r in spark.read.parquet(path).collect())
        assert got == [("a", "2024-01-02", 1.0), ("a", "2024-01-03", 9.0), ("b", "2024-01-02", 2.0), ("c", "2024-01-03", 7.0)]
    tables.append_new(spark, day_rows(spark, [("X", "a", "2024-01-03", 0.0, 1), ("X", "d", "2024-01-03", 5.0, 1)]), path, keys, ["seq"])
    got = {(r.contract_code, str(r.trade_date)): r.close for r in tables.read_range(spark, path, start="2024-01-03").collect()}
    assert got == {("a", "2024-01-03"): 9.0, ("c", "2024-01-03"): 7.0, ("d", "2024-01-03"): 5.0}
    tables.replace(spark, day_rows(spark, [("X", "a", "2024-01-02", 4.0, 1)]), path, ["exchange", "trade_date"])
    assert [(r.contract_code, r.close) for r in tables.read_range(spark, path, end="2024-01-02").collect()] == [("a", 4.0)]


def test_partitioned_write_prunes_and_archives(spark, tmp_path):
    df = day_rows(spark, [("X", "a", f"20{y}-06-01", float(y), 1) for y in (21, 22, 23)])
    tables.write_partitioned(df, str(tmp_path / "y"), by="year", sort=["contract_code"])
    got = tables.read_range(spark, str(tmp_path / "y"), start="2022-01-01", end="2022-12-31", by="year")
    assert [r.close for r in got.collect()] == [22.0]
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()
    for _ in range(2):  # running it again changes nothing
        tables.archive_before(df, str(tmp_path / "arch"), "2022-06-15", 0)
    assert spark.read.parquet(str(tmp_path / "arch")).count() == 2


def test_migration_defaults_and_first_row_per_key(spark):
    src = spark.createDataFrame([("IF1", "2024-01-02", 5.0, 1), ("IF1", "2024-01-02", 6.0, 2)], "instrument_id string, date string, close_price double, n int")
    target = schemas.struct_of("exchange string, contract_code string, trade_date date, close double, source string")
    [r] = tables.migrate(src, target, ["exchange", "contract_code", "trade_date"], ["n"], {"exchange": "CFFEX", "source": "legacy"}).collect()
    assert (r.exchange, r.contract_code, str(r.trade_date), r.close, r.source) == ("CFFEX", "IF1", "2024-01-02", 5.0, "legacy")


def test_upsert_reads_only_touched_folders_and_keeps_the_newest(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["contract_code", "trade_date"]
    first = day_rows(spark, [("X", "a", f"2024-01-0{d}", 1.0, 5) for d in range(1, 8)])
    tables.upsert(spark, first, path, keys, ["seq"])
    batch = day_rows(spark, [("X", "a", "2024-01-03", 9.0, 4)])
    plan = tables.touched(spark, path, batch, "trade_date")._jdf.queryExecution().toString()
    assert "trade_date" in plan.split("PartitionFilters: [")[1] and "2024-01-03" in plan.split("PartitionFilters: [")[1].split("]")[0]
    tables.upsert(spark, batch, path, keys, ["seq"], newest=True)
    assert {r.close for r in spark.read.parquet(path).collect()} == {1.0}  # the stored row is newer
    tables.upsert(spark, batch.withColumn("seq", F.lit(6)), path, keys, ["seq"], newest=True)
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [1.0] * 6 + [9.0]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # no staging folder stays
    with pytest.raises(ValueError):
        tables.upsert(spark, batch, path, ["contract_code"], ["seq"])
