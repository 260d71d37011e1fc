"""Exchange CSV files: daily / weekly / monthly quotes, member rankings, wide rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import literal_map, normalize_date
from tickloom.operators.positions import unpivot_ranking
from tickloom.sources.text_files import read_lines, read_texts

# Exchange header wording to canonical column names, in lookup order.
QUOTE_HEADERS = {
    "交易日": "trade_date", "合约代码": "instrument_id", "开盘价": "open_price",
    "最高价": "high_price", "最低价": "low_price", "收盘价": "close_price",
    "涨跌": "change", "涨跌幅": "change_pct", "涨跌1": "change", "涨跌2": "change_pct",
    "结算价": "settlement_price", "今结算": "settlement_price",
    "前结算价": "pre_settle", "前结算": "pre_settle", "成交量": "volume", "成交金额": "turnover",
    "持仓量": "open_interest", "持仓变化": "oi_change", "日持仓变化": "oi_change",
    "行权价": "strike_price", "执行价": "strike_price", "合约标的": "underlying",
    "期权类型": "option_type", "合约月份": "contract_month", "到期日": "expire_date",
    "Delta": "delta",
}
POSITION_HEADERS = {
    "交易日": "trade_date", "合约代码": "instrument_id", "期货公司会员简称": "member_name",
    "会员简称": "member_name", "多头持仓量": "long_volume", "多头持仓": "long_volume",
    "空头持仓量": "short_volume", "空头持仓": "short_volume", "多头增减": "long_change",
    "多头变化": "long_change", "空头增减": "short_change", "空头变化": "short_change",
}
# Column order of a headerless-style file with exactly this many columns.
POSITIONAL = ["instrument_id", "open_price", "high_price", "low_price", "volume", "turnover",
              "open_interest", "oi_change", "settlement_price", "close_price", "pre_settle",
              "change", "change_pct", "delta"]

QUOTE_NUMERIC = ["open_price", "high_price", "low_price", "close_price", "settlement_price", "pre_settle",
                 "volume", "turnover", "open_interest", "oi_change", "change", "change_pct",
                 "strike_price", "delta"]
QUOTE_TEXT = ["instrument_id", "underlying", "option_type", "contract_month", "expire_date"]
POSITION_NUMERIC = ["long_volume", "short_volume", "long_change", "short_change"]
#: Stands for a comma between cells while a line is cut; no text holds it, as it is no character.
MARK = "\ufdd0"


def _cut(line: Column) -> Column:
    """CSV line of any width to an array of cells as they stand.

    A comma with an even number of quotes behind it separates cells: the line is cut at its quotes,
    and every second piece, counted from the end, has its commas marked.
    """
    from_end = F.reverse(F.split(line, '"'))
    marked = F.transform(from_end, lambda x, i: F.when(i % 2 == 0, F.translate(x, ",", MARK)).otherwise(x))
    return F.when(line.contains('"') | line.contains(MARK), F.split(F.array_join(F.reverse(marked), '"'), MARK)).otherwise(F.split(line, ","))


def _bare(cell: Column) -> Column:
    """A cell trimmed and without its quotes; null if empty."""
    cell = F.trim(cell)
    inner = F.regexp_replace(F.regexp_extract(cell, r'(?s)^"(.*)"$', 1), '""', '"')
    quoted = cell.startswith('"') & cell.rlike(r'(?s)^".*"$')
    return F.nullif(F.trim(F.when(quoted, inner).otherwise(cell)), F.lit(""))


def _cells(line: Column) -> Column:
    """CSV line of any width to an array of trimmed cells; quotes are removed, empty cells are null."""
    return F.transform(_cut(line), _bare)


def _canonical(header: Column, mapping: dict[str, str], positional: bool) -> Column:
    """Header cells to canonical names: exact, else first wording contained either way round."""
    exact = literal_map(mapping)
    words = F.array(*[F.lit(k) for k in mapping])

    def name(h):
        loose = F.get(F.filter(words, lambda k: h.contains(k) | k.contains(h)), 0)
        return F.when((h == "") | h.isNull(), F.lit(None)).otherwise(F.coalesce(exact[h], exact[loose], h))

    mapped = F.transform(header, name)
    if not positional:
        return mapped
    width = F.size(F.filter(header, lambda h: h.isNotNull()))
    fixed = F.array(*[F.lit(p) for p in POSITIONAL])
    return F.when(width == len(POSITIONAL), fixed).otherwise(mapped)


def _rows(texts: DataFrame, mapping: dict[str, str], positional: bool) -> DataFrame:
    """The data lines of ``texts(file, text)``, cut into cells; files may differ in their headers.

    The header is looked up once per text, not per line, and no line carries its text along. A file
    may come in several texts that each begin with its header.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    t = texts.select("file", lines.alias("_lines"))
    t = t.select("file", "_lines", _canonical(_cells(F.get("_lines", F.lit(0))), mapping, positional).alias("_names"))
    data = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(1)))
    return t.select("file", _places(mapping).alias("_at"), data.alias("_data")) \
            .select("file", "_at", F.explode_outer("_data").alias("_line")).filter(F.col("_line").isNotNull()) \
            .select("file", "_at", _cut(F.col("_line")).alias("_cut"))


def _named(lines: DataFrame, mapping: dict[str, str], positional: bool) -> DataFrame:
    """``file, header, line`` cut into cells as ``_rows`` does."""
    names = _canonical(_cells(F.col("header")), mapping, positional)
    return lines.select("file", names.alias("_names"), _cut(F.col("line")).alias("_cut")) \
                .select("file", _places(mapping).alias("_at"), "_cut")


def _places(mapping: dict[str, str]) -> Column:
    """Where each canonical name stands in ``_names``, from 1; 0 if nowhere."""
    # The first column of a name wins, as several wordings share one canonical name.
    return F.struct(*[F.array_position("_names", n).cast("int").alias(n) for n in dict.fromkeys([*mapping.values(), *POSITIONAL])])


def _field(name: str) -> Column:
    at = F.col(f"_at.{name}")
    return _bare(F.get("_cut", F.when(at > 0, at - 1)))


def _number(name: str) -> Column:
    return _field(name).try_cast("double").alias(name)


def read_quotes(spark: SparkSession, path, trade_date: str | None = None, data_type: str = "daily",
                pattern: str | None = "*.csv") -> DataFrame:
    """Daily, weekly or monthly quote files below a path."""
    return parse_quotes(read_texts(spark, path, pattern), trade_date, data_type)


def parse_quotes(texts: DataFrame, trade_date: str | None = None, data_type: str = "daily") -> DataFrame:
    """Quote rows of ``texts(file, text)``. The date is the argument, else the date column, else
    eight digits in the file name. Unparsable numbers become null."""
    return _quotes(_rows(texts, QUOTE_HEADERS, positional=True), trade_date, data_type)


def read_large_quotes(spark: SparkSession, path, trade_date: str | None = None, data_type: str = "daily",
                      pattern: str | None = "*.csv") -> DataFrame:
    """The rows of ``read_quotes`` for files of any size: Spark cuts them at line ends."""
    return _quotes(_named(read_lines(spark, path, pattern), QUOTE_HEADERS, positional=True), trade_date, data_type)


def _quotes(rows: DataFrame, trade_date: str | None, data_type: str) -> DataFrame:
    in_name = F.regexp_extract("file", r"(\d{8})", 1)
    date = normalize_date(F.lit(trade_date)) if trade_date else \
        F.coalesce(normalize_date(_field("trade_date")), normalize_date(in_name))
    return rows.select("file", date.alias("trade_date"), *[_field(c).alias(c) for c in QUOTE_TEXT],
                       *[_number(c) for c in QUOTE_NUMERIC], F.lit(data_type).alias("data_type"))


def read_weekly(spark, path, **kw) -> DataFrame:
    return read_quotes(spark, path, data_type="weekly", **kw)


def read_monthly(spark, path, **kw) -> DataFrame:
    return read_quotes(spark, path, data_type="monthly", **kw)


def to_daily_quotes(quotes: DataFrame, exchange: str) -> DataFrame:
    """Parsed exchange rows in the layout of the daily_quotes table."""
    return quotes.select(
        F.lit(exchange).alias("exchange"), F.trim("instrument_id").alias("contract_code"), "trade_date",
        F.col("open_price").alias("open"), F.col("high_price").alias("high"), F.col("low_price").alias("low"),
        F.col("close_price").alias("close"), F.col("settlement_price").alias("settle"),
        F.col("pre_settle").alias("prev_settle"), F.col("volume").cast("bigint").alias("volume"), "turnover",
        F.col("open_interest").cast("bigint").alias("open_interest"), F.col("change").alias("daily_change"),
        F.col("change_pct").alias("daily_change_pct"),
        ((F.col("high_price") - F.col("low_price")) / F.nullif(F.col("pre_settle"), F.lit(0.0))).alias("amplitude"),
        F.lit("exchange").alias("source"))


def read_positions(spark: SparkSession, path, product: str = "MO", pattern: str | None = "*.csv") -> DataFrame:
    """Member-ranking files below a path."""
    return parse_positions(read_texts(spark, path, pattern), product)


def read_large_positions(spark: SparkSession, path, product: str = "MO", pattern: str | None = "*.csv") -> DataFrame:
    """The rows of ``read_positions`` for files of any size: Spark cuts them at line ends."""
    return _positions(_named(read_lines(spark, path, pattern), POSITION_HEADERS, positional=False), product)


def parse_positions(texts: DataFrame, product: str = "MO") -> DataFrame:
    """Member rankings of ``texts(file, text)`` with the net position per row."""
    return _positions(_rows(texts, POSITION_HEADERS, positional=False), product)


def _positions(rows: DataFrame, product: str) -> DataFrame:
    in_name = F.regexp_extract("file", r"(\d{8})", 1)
    return rows.select(
        "file", F.coalesce(normalize_date(_field("trade_date")), normalize_date(in_name)).alias("trade_date"),
        _field("instrument_id").alias("instrument_id"), _field("member_name").alias("member_name"),
        *[_number(c) for c in POSITION_NUMERIC], F.lit(product).alias("product")) \
        .withColumn("net_position", F.col("long_volume") - F.col("short_volume"))


def position_file_stats(positions: DataFrame) -> DataFrame:
    return positions.groupBy("file", "trade_date", "product").agg(
        F.countDistinct("member_name").alias("member_count"),
        F.countDistinct("instrument_id").alias("instrument_count"),
        F.sum("long_volume").alias("total_long"), F.sum("short_volume").alias("total_short"))


def read_wide_ranking(spark: SparkSession, path, header_rows: int = 3, pattern: str | None = "*.csv") -> DataFrame:
    """Ranking files that list several rankings side by side, as one row per side.

    Columns: date, contract, rank, then member / volume / change of the long and the short side.
    """
    texts = read_texts(spark, path, pattern)
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    body = texts.select("file", F.posexplode(lines).alias("pos", "line")).filter(F.col("pos") >= header_rows) \
                .withColumn("c", _cells(F.col("line"))).filter(F.get("c", F.lit(11)).isNotNull())

    def n(i):
        return F.coalesce(F.regexp_replace(F.get("c", F.lit(i)), ",", "").try_cast("bigint"), F.lit(0))

    wide = body.select(
        normalize_date(F.get("c", F.lit(0))).alias("trade_date"), F.get("c", F.lit(1)).alias("contract_code"),
        n(2).alias("rank"), F.get("c", F.lit(3)).alias("long_member"), n(4).alias("long_volume"), n(5).alias("long_change"),
        F.get("c", F.lit(6)).alias("short_member"), n(7).alias("short_volume"), n(8).alias("short_change")) \
        .filter(F.coalesce(F.col("contract_code"), F.lit("")) != "")
    return unpivot_ranking(wide)
