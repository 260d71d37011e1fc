"""Query facade: one method per question a user of the data asks, each returning a DataFrame.

Tables are resolved by name from explicit frames, a Parquet root folder or the session catalog.
Filters that are not given add no condition; given ones reach the scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars, contracts as con, positions as pos, quality as qa, query as Q, trading


class Client:
    def __init__(self, spark: SparkSession, root: str | None = None, database: str | None = None,
                 tables: dict[str, DataFrame] | None = None):
        self.spark, self.root, self.database, self.tables = spark, root, database, tables or {}

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.root:
            return self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}")
        return self.spark.table(f"{self.database}.{name}" if self.database else name)

    # ---------------------------------------------------------------- market
    def quotes(self, exchange=None, contract=None, start_date=None, end_date=None, frequency: str = "daily") -> DataFrame:
        if frequency == "daily":
            return Q.select_where(self.table("daily_quotes"), equals={"exchange": exchange, "contract_code": contract},
                                  start={"trade_date": start_date}, end={"trade_date": end_date}, order=["trade_date", "contract_code"])
        wanted = None if frequency == "minute" else frequency
        return Q.select_where(self.table("minute_quotes"), equals={"exchange": exchange, "contract_code": contract, "frequency": wanted},
                              start={"trade_date": start_date}, end={"trade_date": end_date}, order=["trade_date", "trade_time"])

    def positions(self, exchange=None, contract=None, trade_date=None) -> DataFrame:
        rows = Q.select_where(self.table("position_detail"), equals={"exchange": exchange, "contract_code": contract, "trade_date": trade_date},
                              order=[F.desc("trade_date"), F.desc("long_volume")])
        return rows.withColumn("net_position", F.col("long_volume") - F.col("short_volume"))

    def contracts(self, exchange=None, variety=None, contract_type=None) -> DataFrame:
        return Q.select_where(self.table("contracts"), equals={"exchange": exchange, "variety": variety, "contract_type": contract_type},
                              order=["contract_code"])

    def top_holders(self, contract: str, trade_date=None, limit: int = 20) -> DataFrame:
        rows = Q.select_where(self.table("position_detail"), equals={"contract_code": contract, "trade_date": trade_date})
        return pos.top_holders(rows, limit, ["contract_code"] if trade_date is None else ["trade_date", "contract_code"])

    def quote_summary(self, contract: str, start_date=None, end_date=None) -> DataFrame:
        return bars.quote_summary(Q.select_where(self.table("daily_quotes"), equals={"contract_code": contract},
                                                 start={"trade_date": start_date}, end={"trade_date": end_date}))

    def minute_summary(self, contract: str, trade_date=None) -> DataFrame:
        return bars.minute_summary(Q.select_where(self.table("minute_quotes"), equals={"contract_code": contract, "trade_date": trade_date}))

    def minute_contracts(self, trade_date=None) -> DataFrame:
        return bars.minute_contracts(self.table("minute_quotes"), trade_date)

    def frequencies(self, contract: str, trade_date=None) -> DataFrame:
        return bars.list_frequencies(Q.select_where(self.table("minute_quotes"), equals={"contract_code": contract, "trade_date": trade_date}))

    def index_daily(self, index_code: str, start_date=None, end_date=None) -> DataFrame:
        return Q.select_where(self.table("daily_index_prices"), equals={"index_code": index_code}, start={"trade_date": start_date},
                              end={"trade_date": end_date}, order=["trade_date"])

    def option_greeks(self, trade_date, symbol=None) -> DataFrame:
        return Q.select_where(self.table("option_greeks_daily"), equals={"trade_date": trade_date, "symbol": symbol}, order=["symbol"])

    def contract_expiry(self, symbol: str) -> DataFrame:
        return Q.select_where(self.table("contract_expiry"), equals={"symbol": symbol})

    def expiring(self, ref, days: int = 30) -> DataFrame:
        return con.expiring(self.table("contract_info"), ref, days).orderBy("last_trade_date", "contract_code")

    # ---------------------------------------------------------------- trading
    def bills(self, account_id=None) -> DataFrame:
        return Q.select_where(self.table("bills"), equals={"account_id": account_id}, order=[F.desc("bill_date_start")])

    def trades(self, account_id=None, start_date=None, end_date=None, instrument=None, direction=None, offset_flag=None) -> DataFrame:
        return Q.select_where(self.table("trades"), equals={"account_id": account_id, "instrument": instrument, "direction": direction,
                                                            "offset_flag": offset_flag},
                              start={"trade_date": start_date}, end={"trade_date": end_date}, order=["trade_date", "id"])

    def matched_trades(self, instrument=None, start_date=None, end_date=None) -> DataFrame:
        return Q.select_where(self.table("matched_trades"), equals={"instrument": instrument}, start={"close_date": start_date},
                              end={"close_date": end_date}, order=[F.desc("close_date")])

    def positions_summary(self, instrument=None, start_date=None, end_date=None) -> DataFrame:
        return Q.select_where(self.table("positions_summary"), equals={"instrument": instrument}, start={"trade_date": start_date},
                              end={"trade_date": end_date}, order=[F.desc("trade_date"), "instrument"])

    def account_summary(self, account_id=None) -> DataFrame:
        return Q.select_where(self.table("account_summary"), equals={"account_id": account_id}, order=["year", "month"])

    def pnl_summary(self, account_id=None, start_date=None, end_date=None) -> DataFrame:
        rows = Q.select_where(self.table("trades"), equals={"account_id": account_id}, start={"trade_date": start_date}, end={"trade_date": end_date})
        return trading.pnl_summary(rows)

    def fund_flows(self, bill_id, start_date=None, end_date=None, flow_type=None) -> DataFrame:
        return Q.select_where(self.table("bill_fund_flows"), equals={"bill_id": bill_id, "flow_type": flow_type},
                              start={"trade_date": start_date}, end={"trade_date": end_date}, order=["trade_date"])

    # ---------------------------------------------------------------- analysis
    def institution_features(self, member_name=None, trade_date=None) -> DataFrame:
        return Q.select_where(self.table("institution_daily_features"), equals={"member_name": member_name, "trade_date": trade_date},
                              order=[F.desc("trade_date")])

    def institution_master(self, category=None) -> DataFrame:
        return Q.select_where(self.table("institution_master"), equals={"category": category}, order=["member_name"])

    def lead_lag(self, trade_date=None) -> DataFrame:
        return Q.select_where(self.table("institution_lead_lag"), equals={"trade_date": trade_date}, order=[F.desc("trade_date")])

    def signals(self, signal_type=None, start_date=None, end_date=None) -> DataFrame:
        return Q.select_where(self.table("trading_signals"), equals={"signal_type": signal_type}, start={"signal_date": start_date},
                              end={"signal_date": end_date}, order=[F.desc("signal_date")])

    def market_regime(self, trade_date=None, contract=None) -> DataFrame:
        return Q.select_where(self.table("market_regime"), equals={"trade_date": trade_date, "contract_code": contract}, order=[F.desc("trade_date")])

    def current_regime(self, contract=None, limit: int | None = None) -> DataFrame:
        """Regimes, newest first, in a total order; ``limit`` keeps the first ones for a display."""
        rows = Q.select_where(self.table("market_regime"), equals={"contract_code": contract})
        rows = rows.orderBy(F.desc("trade_date"), "contract_code")
        return rows if limit is None else rows.limit(limit)

    def tushare_daily(self, ts_code=None, start_date=None, end_date=None) -> DataFrame:
        return Q.select_where(self.table("tushare_daily"), equals={"ts_code": ts_code}, start={"trade_date": start_date},
                              end={"trade_date": end_date}, order=["trade_date"])

    def option_features(self, trade_date=None, contract=None) -> DataFrame:
        return Q.select_where(self.table("option_features"), equals={"trade_date": trade_date, "contract_code": contract},
                              order=[F.desc("trade_date"), "contract_code"])

    def iv_snapshot(self, underlying=None, trade_date=None) -> DataFrame:
        """IV of all options of an underlying; the latest date when none is given."""
        rows = Q.select_where(self.table("option_features"), prefix={"contract_code": underlying}, equals={"trade_date": trade_date},
                              where=[F.col("iv").isNotNull()])
        if trade_date is None:
            rows = rows.filter(F.col("trade_date") == rows.agg(F.max("trade_date")).scalar())
        return rows.orderBy("iv")

    def iv_benchmark(self, variety=None, start_date=None, end_date=None) -> DataFrame:
        return Q.select_where(self.table("iv_benchmark"), equals={"variety": variety}, start={"trade_date": start_date},
                              end={"trade_date": end_date}, order=["trade_date", "variety"])

    def iv_cross_variety(self, start_date=None, end_date=None) -> DataFrame:
        return self.iv_benchmark(None, start_date, end_date).select("trade_date", "variety", "atm_iv", "hv_20", "hv_60", "iv_hv_spread", "iv_regime")

    # ---------------------------------------------------------------- monitoring
    def catalogs(self, exchange=None, product=None, data_type=None, enabled=None) -> DataFrame:
        return Q.select_where(self.table("data_catalog"), equals={"exchange_code": exchange, "product_code": product, "data_type": data_type,
                                                                  "is_enabled": enabled}, order=["id"])

    def events(self, event_type=None, source=None, symbol=None, severity=None, since=None, page_no: int = 1, page_size: int = 100) -> DataFrame:
        rows = Q.select_where(self.table("market_data_event_log"), equals={"event_type": event_type, "source_name": source, "symbol": symbol,
                                                                           "severity": severity}, start={"created_at": since})
        return Q.page(rows, [F.desc("created_at"), F.desc("id")], page_no, page_size)

    def status(self, names: list[str]) -> DataFrame:
        """Rows and columns per table."""
        return qa.table_stats({n: (self.table(n), "trade_date" if "trade_date" in self.table(n).columns else None) for n in names})
