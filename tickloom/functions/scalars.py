"""Scalar building blocks as Column expressions (all stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contract multipliers per product (lower-case product code).
CONTRACT_MULTIPLIERS = {
    "jm": 60, "j": 100, "i": 100,
    "ag": 15, "au": 1000, "cu": 5, "al": 5, "zn": 5, "pb": 5, "ni": 1, "sn": 1, "ss": 5,
    "rb": 10, "hc": 10,
    "p": 10, "l": 5, "v": 5, "pp": 5, "ma": 10, "ta": 5, "fu": 50, "bu": 10, "sp": 10, "pg": 20,
    "m": 10, "y": 10, "a": 10, "b": 10, "c": 10, "cs": 10, "jd": 10, "ap": 10, "cf": 5, "sr": 10,
    "oi": 10, "rm": 10,
    "if": 300, "ic": 200, "ih": 300, "im": 200,
    "ho": 10000, "io": 100, "mo": 100,
    "lc": 1, "si": 5, "ao": 20,
}

# Statement wording to canonical codes.
DIRECTION_CODES = {"买": "buy", "卖": "sell", "买入": "buy", "卖出": "sell"}
OFFSET_CODES = {"开": "open", "平": "close", "开仓": "open", "平仓": "close"}

# Institution category keywords, first hit wins.
INSTITUTION_KEYWORDS = [
    ("futures_company", ["期货", "futures"]),
    ("bank", ["银行", "bank"]),
    ("securities", ["证券", "securities"]),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def band(value, cuts: list[tuple[float, str]], otherwise: str, null_label: str | None = None,
         upper: bool = True) -> Column:
    """Label a value. ``upper`` True: first cut with value < cut; False: value >= cut."""
    value = _c(value)
    expr = None
    if null_label is not None:
        expr = F.when(value.isNull(), F.lit(null_label))
    for cut, label in cuts:
        cond = value < F.lit(cut) if upper else value >= F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def normalize_date(col) -> Column:
    """``YYYY-MM-DD...`` or ``YYYYMMDD`` text to DATE; anything else becomes null."""
    text = F.trim(_c(col).cast("string"))
    iso = F.when(text.rlike(r"^(19|20)\d{2}-\d{2}-\d{2}"),
                 F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    compact = F.when(text.rlike(r"^(19|20)\d{6}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(iso, compact)


def bar_timestamp(trade_date, trade_time) -> Column:
    """Exchange wall-clock stamp from a date and ``HH:MM[:SS]`` (no zone shift)."""
    time = F.regexp_replace(_c(trade_time), r"\s", "")
    time = F.when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    return F.to_timestamp_ntz(
        F.concat(F.date_format(_c(trade_date), "yyyy-MM-dd"), F.lit(" "), time),
        F.lit("yyyy-MM-dd HH:mm:ss"))


def product_code(contract, lower: bool = False) -> Column:
    letters = F.regexp_extract(_c(contract), r"^([A-Za-z]+)", 1)
    return F.lower(letters) if lower else F.upper(letters)


def is_option(instrument) -> Column:
    """An option has a strike: digits, C or P, digits, with or without dashes (so IC, AP and PP futures are none)."""
    return _c(instrument).rlike(r"(?i)[0-9]-?[CP]-?[0-9]")


def instrument_type(instrument) -> Column:
    return F.when(_c(instrument).rlike(r"-([CP])-\d+"), F.lit("option")).otherwise(F.lit("future"))


def option_side(instrument) -> Column:
    hit = F.regexp_extract(_c(instrument), r"-([CP])-\d+", 1)
    return F.when(hit != "", hit)


OPTION_SYMBOL = r"^([A-Z]+)(\d{4,6})-([CP])-(\d+)"


def option_symbol_parts(instrument) -> dict[str, Column]:
    """Underlying, call/put, strike and month-end expiry of ``MO2505-C-8500``."""
    ins = _c(instrument)
    ok = ins.rlike(OPTION_SYMBOL)
    digits = F.regexp_extract(ins, OPTION_SYMBOL, 2)
    yy = F.substring(digits, 1, 2).try_cast("int")
    mm = F.substring(digits, 3, 4).try_cast("int")
    year = F.when(yy < 50, yy + 2000).otherwise(yy + 1900)
    month_ok = mm.between(1, 12)
    return {
        "underlying": F.when(ok, F.regexp_extract(ins, OPTION_SYMBOL, 1)),
        "option_type": F.when(ok, F.when(F.regexp_extract(ins, OPTION_SYMBOL, 3) == "C",
                                         F.lit("call")).otherwise(F.lit("put"))),
        "strike": F.when(ok, F.regexp_extract(ins, OPTION_SYMBOL, 4).try_cast("double")),
        "expiry": F.when(ok & month_ok,
                         F.last_day(F.make_date(year, F.when(month_ok, mm), F.lit(1)))),
    }


VENDOR_OPTION = r"^([A-Z]+)(\d{4,6})([CP])(\d+)$"


def vendor_to_contract(code) -> Column:
    """``MO2505C8500.CFFEX`` to ``MO2505-C-8500``; other codes only lose the suffix."""
    base = F.split_part(_c(code), F.lit("."), F.lit(1))
    return F.regexp_replace(base, VENDOR_OPTION, "$1$2-$3-$4")


def vendor_strike(code) -> Column:
    base = F.split_part(_c(code), F.lit("."), F.lit(1))
    return F.coalesce(F.regexp_extract(base, VENDOR_OPTION, 4).try_cast("double"), F.lit(0.0))


def vendor_option_type(code) -> Column:
    base = F.split_part(_c(code), F.lit("."), F.lit(1))
    side = F.regexp_extract(base, r"^[A-Z]+\d{4,6}([CP])", 1)
    return F.when(side == "C", F.lit("call")).when(side == "P", F.lit("put"))


# Exchange by two-letter product prefix, used for vendor codes.
EXCHANGE_BY_PREFIX = {
    "MO": "CFFEX", "IO": "CFFEX", "HO": "CFFEX",
    "CU": "SHFE", "AL": "SHFE", "ZN": "SHFE",
    "CF": "CZCE", "SR": "CZCE", "TA": "CZCE",
}


def contract_to_vendor(symbol) -> Column:
    sym = _c(symbol)
    exchange = literal_map(EXCHANGE_BY_PREFIX)[F.upper(F.substring(sym, 1, 2))]
    tagged = sym.rlike("CFFEX|SHFE|DCE|CZCE")
    return F.when(tagged | exchange.isNull(), sym).otherwise(F.concat_ws(".", sym, exchange))


def symbol_option_code(symbol) -> Column:
    up = F.upper(_c(symbol))
    return F.when(up.contains("-C-"), F.lit("CE")).when(up.contains("-P-"), F.lit("PE")) \
            .otherwise(F.lit(""))


def symbol_strike(symbol) -> Column:
    return F.coalesce(F.regexp_extract(_c(symbol), r"(?i)-[CP]-(\d+)", 1).try_cast("double"),
                      F.lit(0.0))


def symbol_expiry(symbol) -> Column:
    """First day of the contract month (century pivot 80) or null."""
    digits = F.regexp_extract(_c(symbol), r"[A-Z]+(\d{4})", 1)
    yy = F.substring(digits, 1, 2).try_cast("int")
    mm = F.substring(digits, 3, 2).try_cast("int")
    year = F.when(yy < 80, yy + 2000).otherwise(yy + 1900)
    return F.when(mm.between(1, 12), F.make_date(year, F.when(mm.between(1, 12), mm), F.lit(1)))


def third_friday(date) -> Column:
    first = F.trunc(_c(date), "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)


def front_month_contract(product: str, date) -> Column:
    """``<product>YYMM`` of the month still trading (rolls on the third Friday)."""
    d = _c(date)
    month = F.when(d >= third_friday(d), F.add_months(F.trunc(d, "month"), 1)) \
             .otherwise(F.trunc(d, "month"))
    return F.concat(F.lit(product), F.date_format(month, "yyMM"))


def multiplier(instrument) -> Column:
    return F.coalesce(literal_map(CONTRACT_MULTIPLIERS)[product_code(instrument, lower=True)],
                      F.lit(1)).cast("bigint")


def holding_days(open_date, close_date) -> Column:
    return F.coalesce(F.datediff(_c(close_date), _c(open_date)), F.lit(0)).cast("bigint")


def years_to_expiry(trade_date, expiry) -> Column:
    days = F.datediff(_c(expiry), _c(trade_date))
    return F.when(days > 0, days / F.lit(365.0))


def valid_tenor(years) -> Column:
    return (_c(years) > 1e-6) & (_c(years) <= 5.0)


def institution_category(name) -> Column:
    low = F.lower(_c(name))
    expr = None
    for label, words in INSTITUTION_KEYWORDS:
        cond = low.contains(words[0]) | low.contains(words[1])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("other"))


def clean_number(col, default: float | None = 0.0, as_type: str = "double") -> Column:
    """Strip commas and blanks; blank, ``-`` or junk becomes ``default``."""
    text = F.regexp_replace(_c(col), r"[,\s]", "")
    value = text.try_cast("double")
    if as_type != "double":
        value = value.try_cast(as_type)
    return value if default is None else F.coalesce(value, F.lit(default).cast(as_type))


def map_code(col, mapping: dict[str, str]) -> Column:
    """Known code to its canonical form; unknown values pass through."""
    return F.coalesce(literal_map(mapping)[_c(col)], _c(col))


def long_short_columns(direction, volume) -> tuple[Column, Column]:
    """Split one signed holding row into (long, short) volumes."""
    d, v = _c(direction), _c(volume)
    is_long = d.isin("买", "buy", "long")
    is_short = d.isin("卖", "sell", "short")
    return F.when(is_long, v).otherwise(0), F.when(is_short, v).otherwise(0)


def iv_regime(percentile) -> Column:
    return band(percentile, [(10, "very_low"), (30, "low"), (70, "normal"), (90, "high")],
                "very_high", null_label="normal")


def quality_level(score) -> Column:
    return band(score, [(95, "excellent"), (85, "good"), (70, "fair"), (50, "poor")],
                "critical", upper=False)


def consistency_status(score) -> Column:
    return band(score, [(95, "consistent"), (80, "minor_issues")], "inconsistent", upper=False)


def heat_band(score) -> Column:
    return band(score, [(90, "green"), (60, "yellow")], "red", upper=False)


def drift_status(drift, actual) -> Column:
    d = _c(drift)
    return F.when(d == 0, F.lit("ok")) \
            .when(d < F.greatest(_c(actual) * F.lit(0.01), F.lit(100.0)), F.lit("warn")) \
            .otherwise(F.lit("error"))


# Keyword in a table name to the source that feeds it, first hit wins.
SOURCE_PATTERNS = [
    ("cffex", "cffex"), ("shfe", "shfe"), ("bill", "cfmmc"), ("statement", "cfmmc"),
    ("akshare", "akshare"),
]


def infer_source(table_name) -> Column:
    name = _c(table_name)
    expr = F.when(name.startswith("tushare"), F.lit("tushare"))
    for needle, label in SOURCE_PATTERNS:
        expr = expr.when(name.contains(needle), F.lit(label))
    return expr.otherwise(F.lit("exchange"))


def json_error(checkpoint) -> Column:
    """``$.error`` of a checkpoint document; null when absent or not JSON."""
    return F.get_json_object(_c(checkpoint), "$.error")


def minute_of_day(time) -> Column:
    t = _c(time)
    return F.substring(t, 1, 2).try_cast("int") * 60 + F.substring(t, 4, 2).try_cast("int")


def second_of_day(time) -> Column:
    """``HH:MM[:SS]`` as a number, which orders and aggregates without string buffers."""
    t = _c(time)
    return minute_of_day(t) * 60 + F.coalesce(F.substring(t, 7, 2).try_cast("int"), F.lit(0))
