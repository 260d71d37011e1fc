"""Explicit schemas and keys of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
           "date": T.DateType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
           "money": T.DecimalType(20, 4)}


def struct_of(spec: str) -> T.StructType:
    """``"name type, ..."`` of simple types to a StructType (usable before a session exists)."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in fields])


MONEY = "money"

DAILY_QUOTES = struct_of(
    "exchange string, contract_code string, trade_date date, open double, high double, "
    "low double, close double, settle double, prev_settle double, volume bigint, "
    "turnover double, open_interest bigint, daily_change double, daily_change_pct double, "
    "amplitude double, source string")

MINUTE_QUOTES = struct_of(
    "exchange string, contract_code string, trade_date date, trade_time string, "
    "frequency string, open double, high double, low double, close double, volume bigint, "
    "turnover double, open_interest bigint, vwap double, source string")

POSITION_DETAIL = struct_of(
    "exchange string, trade_date date, contract_code string, product string, "
    "member_name string, rank int, long_volume bigint, short_volume bigint, "
    "long_change bigint, short_change bigint")

CONTRACT_INFO = struct_of(
    "contract_code string, exchange_code string, product_code string, contract_type string, "
    "underlying_contract string, strike_price double, listing_date date, "
    "last_trade_date date, delivery_date date, expiry_date date, delisting_date date, "
    "multiplier double, tick_size double, status string")

TRADES = struct_of(
    "id bigint, account_id string, trade_date date, instrument string, exchange string, "
    "product string, direction string, offset_flag string, volume bigint, price double, "
    "commission double, premium double, total_pnl double, turnover double")

BILLS = struct_of(
    f"id bigint, account_id string, bill_date_start date, bill_date_end date, "
    f"balance_bf {MONEY}, balance_cf {MONEY}, deposit_withdrawal {MONEY}, "
    f"realized_pl {MONEY}, mtm_pl {MONEY}, exercise_pl {MONEY}, commission {MONEY}, "
    f"premium_received {MONEY}, premium_paid {MONEY}, client_equity {MONEY}, "
    f"fund_available {MONEY}, margin_occupied {MONEY}")

FUND_FLOWS = struct_of(
    f"bill_id bigint, trade_date date, flow_type string, amount {MONEY}, symbol string, "
    f"description string")

TICK = struct_of(
    "symbol string, exchange string, asset_type string, timestamp bigint, open double, "
    "high double, low double, close double, volume bigint, open_interest bigint, "
    "pre_close double, bid_price1 double, bid_volume1 bigint, ask_price1 double, "
    "ask_volume1 bigint, option_type string, strike_price double, expiry_date string, "
    "underlying_symbol string, underlying_price double, implied_volatility double, "
    "delta double, gamma double, vega double, theta double, rho double, moneyness string, "
    "days_to_expiry int, theoretical_price double, data_source string, is_backfill boolean, "
    "data_quality string")

SESSION = struct_of("start string, end string")
TRADING_HOURS_TEMPLATE = T.StructType([
    *struct_of("template_id string, exchange_code string, product_type string").fields,
    T.StructField("normal_schedule", T.ArrayType(SESSION)), T.StructField("night_schedule", T.ArrayType(SESSION)),
    T.StructField("pre_open", SESSION), T.StructField("pre_close", SESSION)])

# Keys define what "same row" means for upserts and de-duplication.
KEYS = {
    "daily_quotes": ["exchange", "contract_code", "trade_date"],
    "minute_quotes": ["exchange", "contract_code", "trade_date", "trade_time", "frequency"],
    "position_detail": ["exchange", "trade_date", "contract_code", "member_name"],
    "trade_calendar": ["trade_date", "exchange_code", "product_code"],
    "special_date_override": ["exchange_code", "trade_date"],
    "main_contract_map": ["product_code", "trade_date"],
    "option_iv_daily": ["trade_date", "contract_code", "source"],
    "iv_benchmark": ["trade_date", "variety"],
    "iv_smile_snapshot": ["trade_date", "variety", "expiry_date"],
    "data_health_snapshot": ["catalog_id", "snapshot_date"],
    "data_quality_metrics": ["symbol", "trade_date", "source_name"],
    "option_greeks_daily": ["trade_date", "symbol"],
    "daily_index_prices": ["index_code", "trade_date"],
    "contract_expiry": ["symbol"],
    "vendor_daily": ["ts_code", "trade_date"],
}
