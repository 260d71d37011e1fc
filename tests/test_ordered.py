import random

from pyspark.sql import functions as F

from tickloom.operators import joins
from tickloom.operators.ordered import Scan, exact_quantiles, id_block, prefix_scan, row_blocks
from tickloom.streaming import alerts, ticks


def test_prefix_scan_equals_plain_running_values_on_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}", i, rnd.randrange(20) - 5, rnd.choice([None, i]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, id bigint, v bigint, x bigint").withColumn("_b", id_block("id", 17))
    out = prefix_scan(df, ["k"], ["_b"], ["id"], [
        Scan("s", "sum", F.col("v")), Scan("before", "sum", F.col("v"), inclusive=False), Scan("m", "max", F.col("v")),
        Scan("l", "last", F.col("x")), Scan("prev", "last", F.col("id"), inclusive=False)]).collect()
    state = {}
    want = {}
    for k, i, v, x in rows:
        s, m, l, p = state.get(k, (0, None, None, None))
        want[i] = (s + v, s, v if m is None else max(m, v), x if x is not None else l, p)
        state[k] = (s + v, want[i][2], want[i][3], i)
    assert {r.id: (r.s, r.before, r.m, r.l, r.prev) for r in out} == want


def test_exact_quantiles_with_one_dominant_value(spark):
    rnd = random.Random(5)
    data = {"a": [1.5] * 400 + [rnd.random() * 100 for _ in range(800)], "b": [float(i) for i in range(7)], "c": [2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: (r.p50, r.p95, r.p99) for r in
           exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, rows=100).collect()}
    for k, vs in data.items():
        s = sorted(vs)
        assert got[k] == tuple(s[int(len(s) * p)] for p in (0.5, 0.95, 0.99))


def test_asof_join_takes_the_latest_row_at_or_before(spark):
    left = spark.createDataFrame([("a", "2024-01-31", 1), ("a", "2024-03-05", 2), ("b", "2024-01-01", 3)], "k string, d string, id int") \
        .withColumn("d", F.col("d").cast("date"))
    right = spark.createDataFrame([("a", "2024-01-31", 10.0), ("a", "2024-02-10", 11.0), ("b", "2024-01-02", 12.0)],
                                  "k string, s string, px double").withColumn("s", F.col("s").cast("date"))
    got = {r.id: r.px for r in joins.asof_join(left, right, ["k"], "d", "s", ["px"]).collect()}
    assert got == {1: 10.0, 2: 11.0, 3: None}


def test_live_on_date_prefers_the_latest_listing(spark):
    c = spark.createDataFrame([("MO", "A", "2024-01-01", "2024-01-10"), ("MO", "B", "2024-01-05", None)],
                              "product string, contract_code string, listing_date string, delisting_date string")
    c = c.withColumns({x: F.col(x).cast("date") for x in ("listing_date", "delisting_date")})
    d = spark.createDataFrame([("MO", x) for x in ("2023-12-31", "2024-01-03", "2024-01-07", "2024-02-01")], "product string, trade_date string") \
        .withColumn("trade_date", F.col("trade_date").cast("date"))
    got = {str(r.trade_date): r.contract_code for r in joins.live_on_date(d, c, "product").collect()}
    assert got == {"2023-12-31": None, "2024-01-03": "A", "2024-01-07": "B", "2024-02-01": "B"}


def hot_ticks(spark):
    """One key holds 90 % of the rows, most of them in one hour."""
    rnd = random.Random(7)
    rows = {("hot" if i % 10 else f"k{i % 7}", rnd.randrange(3600) if rnd.random() < 0.8 else rnd.randrange(86_400)) for i in range(6000)}
    rows = [(k, s, i, float(rnd.randrange(100))) for i, (k, s) in enumerate(sorted(rows))]
    return rows, spark.createDataFrame(rows, "k string, s long, id long, value double") \
        .withColumn("ts", F.timestamp_seconds(F.col("s") + 1_704_272_400).cast("timestamp_ntz"))


def test_row_blocks_bound_a_hot_key(spark):
    rows, df = hot_ticks(spark)
    blocked = row_blocks(df, ["k"], "ts", "hour", 100)
    sizes = blocked.groupBy("k", "_block", "_part").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).collect()
    assert sum(r.n for r in sizes) == len(rows) and max(r.n for r in sizes) <= 101  # one tick a second and key
    spans = sorted((r.k, r._block, r._part, r.a, r.b) for r in sizes)
    assert all(x[0] != y[0] or x[4] < y[3] for x, y in zip(spans, spans[1:], strict=False))
    last, want = {}, set()
    for k, s, *_ in rows:
        if k in last and s - last[k] > 5:
            want.add((k, last[k], s))
        last[k] = s
    stamp = F.unix_seconds
    got = ticks.gaps(df, ["k"], session=None, rows=100)
    got = {(r.k, r.a - 1_704_272_400, r.b - 1_704_272_400) for r in got.select(
        "k", stamp(F.col("gap_start").cast("timestamp")).alias("a"), stamp(F.col("gap_end").cast("timestamp")).alias("b")).collect()}
    assert got == want


def test_runs_and_asof_do_not_depend_on_blocks(spark):
    rows, df = hot_ticks(spark)
    rules = alerts.rules_frame(spark, [alerts.AlertRule("high", "hot", ">", 40.0, 0, 0)])
    metrics = df.select(F.col("k").alias("metric_name"), "ts", "value")
    runs = [sorted(map(tuple, alerts.breach_runs(metrics, rules, rows=n).collect())) for n in (50, 10**6)]
    assert runs[0] == runs[1] and len(runs[0]) > 100
    left, right = df.filter("id % 3 = 0"), df.filter("id % 3 = 1").select("k", F.col("ts").alias("at"), F.col("value").alias("px"))
    got = {r.id: r.px for r in joins.asof_join(left, right, ["k"], "ts", "at", ["px"], "day", rows=50).collect()}
    want, last = {}, {}
    for k, _, i, v in rows:
        last[k] = v if i % 3 == 1 else last.get(k)
        if i % 3 == 0:
            want[i] = last[k]
    assert got == want


def test_sketches_merge_over_any_window(spark):
    rows, df = hot_ticks(spark)
    sketches = alerts.metric_sketches(df, ["k"]).cache()
    for start, end in ((None, None), ("2024-01-03 09:10:00", "2024-01-03 09:40:00")):
        part = df if start is None else df.filter(f"ts >= timestamp_ntz'{start}' and ts < timestamp_ntz'{end}'")
        exact = {r.k: r for r in alerts.histogram_stats(part, ["k"]).collect()}
        merged = alerts.merged_histogram(sketches, ["k"], start, end).collect()
        values = {}
        for r in part.select("k", "value").collect():
            values.setdefault(r.k, []).append(r.value)
        assert len(merged) == len(exact) > 5
        for r in merged:
            own, all_ = exact[r.k], values[r.k]
            assert (r["count"], r.min, r.max) == (own["count"], own.min, own.max)
            for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                below, upto = sum(v < r[p] for v in all_) / len(all_), sum(v <= r[p] for v in all_) / len(all_)
                assert below <= q + alerts.RANK_ERROR and upto >= q - alerts.RANK_ERROR
