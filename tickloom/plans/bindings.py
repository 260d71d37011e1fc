"""Market, trading and statement frames derived from the driver's star-schema tables.

The test tables hold no market data, so each domain frame is a deterministic projection or
aggregation of them; ``oracle_ctes`` holds the same derivations as SQL.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import calendar as cal
from tickloom.session import staged

MONEY = "decimal(18,2)"
#: Rows of a fact table that one task groups or scans, about.
TASK_ROWS = 500_000


def dec(c, kind: str = MONEY) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(kind)


def ratio_sum(num: Column, den: Column) -> Column:
    return F.sum(num).cast("double") / F.sum(den).cast("double")


class Frames:
    """Lazy domain frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _tasks(self) -> int:
        """Tasks that the rows of the fact table ask for; counting them reads the file footers only."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // TASK_ROWS))

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows of the fact table, or fewer, dealt by ``keys`` so that more input gives more tasks and
        not larger ones: a group by these keys neither keeps a map of a whole input split before the
        shuffle, nor one of as many rows as fit the size to which adaptive execution merges after it."""
        return rows.repartition(self._tasks, *keys)

    # ---------------------------------------------------------------- quotes
    @cached_property
    def ticks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").select(
            F.col("event_id").alias("id"), F.lit("EVT").alias("exchange"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("contract_code"),
            "ts", F.to_date("ts").alias("trade_date"), F.date_format("ts", "HH:mm:ss").alias("trade_time"),
            F.lit("1min").alias("frequency"), F.col("event_type").alias("source"),
            F.col("value").alias("price"), F.col("value").alias("open"), F.col("value").alias("high"),
            F.col("value").alias("low"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("close"),
            k.alias("volume"), (dec("value") * k).cast("decimal(28,2)").alias("turnover"),
            F.col("event_id").alias("open_interest"))

    @cached_property
    def daily_quotes(self) -> DataFrame:
        p = F.col("l_extendedprice") / F.col("l_quantity")
        qty = F.col("l_quantity").cast("bigint")
        rows = self.table("lineitem").withColumn("trade_date", F.to_date("l_shipdate"))
        g = self.dealt(rows, "l_suppkey", "trade_date").groupBy("l_suppkey", "trade_date").agg(
            ((F.max(p) + F.min(p)) / 2).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
            ratio_sum(dec("l_extendedprice"), qty).alias("close"),
            ((F.max(p) + F.min(p)) / 2).alias("settle"), F.sum(qty).alias("volume"),
            F.sum(dec("l_extendedprice")).cast("decimal(28,2)").alias("turnover"),
            F.sum(F.col("l_linenumber").cast("bigint")).alias("open_interest"))
        return g.select(
            F.concat(F.lit("EX"), (F.col("l_suppkey") % 5).cast("string")).alias("exchange"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("contract_code"),
            *[c for c in g.columns if c != "l_suppkey"])

    @cached_property
    def _life(self) -> DataFrame:
        return self.table("lineitem").groupBy("l_suppkey").agg(
            F.to_date(F.min("l_shipdate")).alias("listing_date"),
            F.to_date(F.max("l_shipdate")).alias("last_trade_date"))

    @cached_property
    def _ends(self) -> list[DataFrame]:
        """First and last order and shipment."""
        return [self.table(t).agg(F.to_date(F.min(c)).alias("a"), F.to_date(F.max(c)).alias("b"))
                for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]

    @cached_property
    def contracts(self) -> DataFrame:
        life = self._life
        s = self.table("supplier").join(
            self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
        return life.join(s, life.l_suppkey == s.s_suppkey).select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("contract_code"),
            F.concat(F.lit("EX"), (F.col("s_suppkey") % 5).cast("string")).alias("exchange"),
            F.col("n_name").alias("product_code"),
            F.when(F.col("s_suppkey") % 3 == 0, "option_call").otherwise("futures").alias("contract_type"),
            "listing_date", "last_trade_date",
            F.when(F.col("s_acctbal") < 0, "suspended").otherwise("active").alias("status"))

    # ---------------------------------------------------------------- positions
    @cached_property
    def positions(self) -> DataFrame:
        l = self.table("lineitem").select(
            "l_partkey", "l_suppkey", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"),
            F.to_date(F.trunc("l_shipdate", "month")).alias("trade_date"))
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        kind = F.col("l_suppkey") % 4
        keys = ["trade_date", "p_brand", "l_suppkey"]
        g = self.dealt(l.join(p, "l_partkey"), *keys).groupBy(*keys).agg(
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("q")).otherwise(0)).alias("long_volume"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("q")).otherwise(0)).alias("short_volume"))
        g = g.select(
            F.lit("EX0").alias("exchange"), "trade_date", F.col("p_brand").alias("contract_code"),
            F.concat(F.lit("M"), F.col("l_suppkey").cast("string"),
                     F.when(kind == 0, "期货").when(kind == 1, " Bank").when(kind == 2, " Securities")
                      .otherwise("")).alias("member_name"), "long_volume", "short_volume")
        w = Window.partitionBy("trade_date", "contract_code").orderBy(F.desc("long_volume"), "member_name")
        return g.withColumn("rank", F.row_number().over(w))

    # ---------------------------------------------------------------- trades and statements
    @cached_property
    def trades(self) -> DataFrame:
        e = self.table("events")
        uid = F.col("user_id")
        ins = F.when(uid % 3 == 0, F.concat(F.lit("MO2405-"), F.when(uid % 2 == 0, "C").otherwise("P"),
                                            F.lit("-"), (uid * 10 + 5000).cast("string"))) \
               .when(uid % 3 == 1, F.concat(F.element_at(F.array(*map(F.lit, ("rb", "IC", "PP", "P"))), (uid % 4 + 1).cast("int")),
                                            (uid + 2400).cast("string"))) \
               .otherwise(F.concat(F.lit("U"), uid.cast("string")))
        v = dec("value")
        k = F.get_json_object("props", "$.k").cast("bigint")
        kind = F.col("event_type")
        return e.select(
            F.col("event_id").alias("id"), F.concat(F.lit("A"), (uid % 10).cast("string")).alias("account_id"),
            F.to_date("ts").alias("trade_date"), ins.alias("instrument"), F.lit("EVT").alias("exchange"),
            F.concat(F.lit("P"), (uid % 3).cast("string")).alias("product"),
            F.when(kind.isin("purchase", "error"), "buy").otherwise("sell").alias("direction"),
            F.when(kind.isin("purchase", "view"), "open").when(kind == "signup", "close_today").otherwise("close")
             .alias("offset_flag"),
            k.alias("volume"), F.col("value").alias("price"),
            (v * F.lit(Decimal("0.01"))).cast("decimal(18,4)").alias("commission"),
            F.when(uid % 3 == 0, v * 10).otherwise(F.lit(Decimal("0.00"))).cast(MONEY).alias("premium"),
            (v - 20).cast(MONEY).alias("total_pnl"), (v * k).cast("decimal(28,2)").alias("turnover"))

    @cached_property
    def bills(self) -> DataFrame:
        price = dec("o_totalprice")

        def when(status):
            return F.sum(F.when(F.col("o_orderstatus") == status, price).otherwise(F.lit(Decimal("0.00")))).cast(MONEY)

        d = self.table("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("bill_date_start")).agg(
            when("P").alias("deposit_withdrawal"), when("F").alias("realized_pl"), when("O").alias("mtm_pl"),
            (F.count(F.lit(1)) * 5).cast(MONEY).alias("commission"))
        flow = F.col("deposit_withdrawal") + F.col("realized_pl") + F.col("mtm_pl") - F.col("commission")
        w = Window.partitionBy("o_custkey").orderBy("bill_date_start").rowsBetween(Window.unboundedPreceding, -1)
        bf = (F.lit(Decimal("1000000.00")) + F.coalesce(F.sum(flow).over(w), F.lit(Decimal("0.00")))).cast(MONEY)
        off = F.when(F.col("o_custkey") % 10 == 0, Decimal("50.00")).when(F.col("o_custkey") % 10 == 1, Decimal("50000.00")) \
               .otherwise(Decimal("0.00"))
        d = d.withColumn("balance_bf", bf).withColumn("balance_cf", (F.col("balance_bf") + flow + off).cast(MONEY))
        zero = F.lit(Decimal("0.00")).cast(MONEY)
        day = F.datediff("bill_date_start", F.lit("1990-01-01").cast("date"))
        return d.select(
            (F.col("o_custkey") * 100000 + day).cast("bigint").alias("id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_id"),
            "bill_date_start", F.col("bill_date_start").alias("bill_date_end"), "balance_bf", "balance_cf",
            "deposit_withdrawal", "realized_pl", "mtm_pl", zero.alias("exercise_pl"), "commission",
            zero.alias("premium_received"), zero.alias("premium_paid"), F.col("balance_cf").alias("client_equity"),
            (F.col("balance_cf") - F.col("commission")).cast(MONEY).alias("fund_available"),
            F.col("mtm_pl").alias("margin_occupied"))

    # ---------------------------------------------------------------- options
    @cached_property
    def chain(self) -> DataFrame:
        l = self.table("lineitem").select(
            "l_partkey", "l_linestatus", "l_discount", "l_tax", F.col("l_quantity").cast("bigint").alias("q"),
            F.col("l_linenumber").cast("bigint").alias("n"),
            F.to_date(F.trunc("l_shipdate", "month")).alias("trade_date"))
        g = l.groupBy("trade_date", "l_partkey", "l_linestatus").agg(
            (F.sum(dec("l_discount")).cast("double") / F.count(F.lit(1)) * 4.0 + 0.1).alias("iv"),
            (F.sum(dec("l_tax")).cast("double") / F.count(F.lit(1)) * 10.0 + 0.05).alias("_d"),
            F.sum("q").alias("volume"), F.sum("n").alias("open_interest"))
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
        call = F.col("l_linestatus") == "O"
        under = F.element_at(F.array(F.lit("MO"), F.lit("IO"), F.lit("HO")), (F.col("l_partkey") % 3 + 1).cast("int"))
        return g.join(p, "l_partkey").select(
            "trade_date", under.alias("underlying"),
            F.concat(under, F.col("l_partkey").cast("string"), F.when(call, "-C").otherwise("-P")).alias("contract_code"),
            F.when(call, "C").otherwise("P").alias("option_type"), F.col("p_retailprice").alias("strike"),
            F.add_months("trade_date", F.col("p_size") % 6 + 1).alias("expire_date"), "iv",
            F.when(call, F.col("_d")).otherwise(-F.col("_d")).alias("delta"), "volume", "open_interest")

    @cached_property
    def underlying_daily(self) -> DataFrame:
        l = self.table("lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("q"),
                                          F.to_date("l_shipdate").alias("trade_date"))
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        under = F.element_at(F.array(F.lit("MO"), F.lit("IO"), F.lit("HO")), (F.col("l_partkey") % 3 + 1).cast("int"))
        return l.join(p, "l_partkey").groupBy("trade_date", under.alias("underlying")).agg(
            ratio_sum(dec("p_retailprice") * F.col("q"), F.col("q")).alias("close"),
            F.max("p_retailprice").alias("high"), F.min("p_retailprice").alias("low"), F.sum("q").alias("volume"))

    # ---------------------------------------------------------------- calendar
    @cached_property
    def days(self) -> DataFrame:
        """Every day from the first order or shipment to the last one, in whole years and months."""
        span = self._ends[0].unionByName(self._ends[1]).agg(F.trunc(F.min("a"), "year").alias("a"), F.last_day(F.max("b")).alias("b"))
        return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("trade_date"))

    @cached_property
    def holidays(self) -> DataFrame:
        fixed = F.date_format("trade_date", "MM-dd")
        return self.days.filter(fixed.isin("01-01", "05-01", "10-01")) \
                   .select("trade_date", F.concat(F.lit("H"), fixed).alias("holiday_name"))

    @cached_property
    def calendar(self) -> DataFrame:
        return cal.build_calendar(self.days, self.holidays)

    @cached_property
    def overrides(self) -> DataFrame:
        dom, dow = F.dayofmonth("trade_date"), F.dayofweek("trade_date")
        rules = [("ALL", "workday", (dom == 15) & (dow == 7)), ("EX0", "holiday", (dom == 20) & (dow == 2)),
                 ("ALL", "holiday", dom == 10), ("EX0", "half_day", dom == 10)]
        hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(x).alias("exchange_code"), F.lit(t).alias("override_type")))
                                         for x, t, c in rules]))
        return self.days.select("trade_date", F.inline(hits))

    @cached_property
    def resolved(self) -> DataFrame:
        """Calendar of exchange EX0: its own rows are absent, so the ALL calendar stands in."""
        own = self.calendar.withColumn("exchange_code", F.lit("EX0"))
        return cal.resolve_calendar(self.days, own, self.overrides, "EX0")

    # ---------------------------------------------------------------- monitoring
    @cached_property
    def metrics(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("metric_name"), "ts", "value",
                                           F.col("event_id").alias("id"))

    @cached_property
    def raw_ticks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            F.col("event_id").alias("id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
            "ts", F.to_date("ts").alias("trade_date"), F.col("event_type").alias("data_source"), ms.alias("timestamp"),
            (ms + k * 30).alias("arrival_ms"), F.col("value").alias("open"),
            F.when(k % 10 == 0, F.col("value") - 1).otherwise(F.col("value")).alias("high"),
            F.col("value").alias("low"), F.when(k % 7 != 0, F.col("value")).alias("close"), k.alias("volume"),
            (k / F.lit(40.0)).alias("implied_volatility"), ((k - 50) / F.lit(45.0)).alias("delta"),
            F.when(k % 2 == 0, "CALL").otherwise("PUT").alias("option_type"))

    @cached_property
    def catalogs(self) -> DataFrame:
        """One tracked daily series per exchange and product."""
        c = self.contracts.groupBy("exchange", "product_code").agg(
            F.min("listing_date").alias("earliest_date"), F.max("last_trade_date").alias("latest_date"))
        return c.select(F.concat_ws("/", "exchange", "product_code").alias("catalog_id"),
                        F.col("exchange").alias("exchange_code"), "product_code", F.lit("daily").alias("data_type"),
                        "earliest_date", "latest_date")

    @cached_property
    def catalog_quotes(self) -> DataFrame:
        """Daily quotes tagged with the series they belong to."""
        return self._tagged(self.daily_quotes, self.contracts)

    @cached_property
    def contract_series(self) -> DataFrame:
        """The same rows dealt by contract, for plans that go through the days of each contract."""
        return self._tagged(self.dealt(self.daily_quotes, "contract_code"), self.dealt(self.contracts, "contract_code"))

    def _tagged(self, quotes: DataFrame, contracts: DataFrame) -> DataFrame:
        dim = contracts.select("contract_code", "product_code")
        return quotes.join(dim, "contract_code") \
                     .withColumn("catalog_id", F.concat_ws("/", "exchange", "product_code"))

    @cached_property
    def sync_tasks(self) -> DataFrame:
        k = F.col("o_custkey")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("EX"), (k % 5).cast("string")).alias("exchange_code"),
            F.concat(F.lit("T"), (k % 25).cast("string")).alias("catalog_id"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
             .otherwise("failed").alias("status"),
            F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('{"error": "E'), (k % 7).cast("string"), F.lit('"}')))
             .otherwise(F.lit("{}")).alias("checkpoint_data"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("error_type"))


class StagedFrames(Frames):
    """Frames for plans that look at the quotes many times: the fact table is read once, reduced to
    one row per contract and day, and everything else is taken from that table."""

    @cached_property
    def daily_quotes(self) -> DataFrame:
        return staged(super().daily_quotes)

    @cached_property
    def _life(self) -> DataFrame:
        return self.daily_quotes.groupBy(F.substring("contract_code", 2, 20).cast("bigint").alias("l_suppkey")).agg(
            F.min("trade_date").alias("listing_date"), F.max("trade_date").alias("last_trade_date"))

    @cached_property
    def _ends(self) -> list[DataFrame]:
        return [super()._ends[0], self.daily_quotes.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))]

    @cached_property
    def contracts(self) -> DataFrame:
        return staged(super().contracts)

    @cached_property
    def resolved(self) -> DataFrame:
        return staged(super().resolved)
