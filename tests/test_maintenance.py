"""Writers that keep tables: the quality summary and the archive."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import quality as qa
from tickloom.sources import tables

D0 = date(2024, 1, 1)


def quotes(spark):
    rows = [(f"EX/P{c % 2}", "EX", f"c{c}", D0 + timedelta(d), 100.0 + (d * 7 + c) % 13, 100.0 + c % 3, (d + c) % 5, float(100 + d % 2))
            for c in range(5) for d in range(40)]
    return spark.createDataFrame(rows, "catalog_id string, exchange string, contract_code string, trade_date date, close double, "
                                       "settle double, volume bigint, other_close double")


def positions(spark):
    rows = [("POS/x", D0 + timedelta(d), r, r - 2, 3, "" if r == 4 else "m") for d in range(40) for r in range(d % 3, 25, 4)]
    return spark.createDataFrame(rows, "catalog_id string, trade_date date, rank int, long_volume bigint, short_volume bigint, member_name string")


def test_two_batches_of_the_quality_summary_equal_one(spark, tmp_path):
    q, p = quotes(spark), positions(spark)
    qa.update_quality_summary(spark, qa.quality_summary(q, p), str(tmp_path / "one"))
    cut = D0 + timedelta(17)
    qa.update_quality_summary(spark, qa.quality_summary(q.filter(F.col("trade_date") < cut), p.filter(F.col("trade_date") < cut)), str(tmp_path / "two"))
    # The second batch is sent twice and brings the day before its first one for the previous close.
    near = F.col("trade_date") >= cut - timedelta(1)
    for _ in range(2):
        qa.update_quality_summary(spark, qa.quality_summary(q.filter(near), p.filter(near), since=cut), str(tmp_path / "two"))
    one, two = (sorted(map(tuple, spark.read.parquet(str(tmp_path / n)).collect())) for n in ("one", "two"))
    assert one == two and len(one) == 3 * 40


def test_scores_come_from_the_summary(spark):
    q, p = quotes(spark), positions(spark)
    summary = qa.quality_summary(q, p)
    series = spark.createDataFrame([("EX/P0", "daily"), ("EX/P1", "daily"), ("POS/x", "position"), ("EX/none", "daily")], "catalog_id string, data_type string") \
        .withColumn("earliest_date", F.lit(D0)).withColumn("latest_date", F.lit(D0 + timedelta(39)))
    from tickloom.operators import calendar as cal
    days = spark.createDataFrame([(D0 + timedelta(d),) for d in range(60)], "trade_date date")
    calendar = cal.build_calendar(days, days.limit(0).withColumn("holiday_name", F.lit("")))
    empty = spark.createDataFrame([], "trade_date date, exchange_code string, override_type string")
    resolved = cal.resolve_calendar(days, calendar, empty, "EX")
    got = {r.catalog_id: r for r in qa.scores_from_summary(series, summary, resolved, last=10).collect()}
    rows = [r for r in q.collect() if r.catalog_id == "EX/P0" and r.trade_date >= D0 + timedelta(30)]
    mean = sum(round(abs(r.close - r.other_close) / r.other_close * 100, 4) for r in rows) / len(rows)
    assert got["EX/P0"].accuracy == pytest.approx(max(0, 100 - 20 * mean), abs=0.01)
    ranks = [(r["rank"], r.long_volume, r.member_name) for r in p.collect()]
    bad = sum((not 1 <= r <= 20) + (v < 0) + (m == "") for r, v, m in ranks)
    assert got["POS/x"].consistency == pytest.approx(max(0, 100 - bad / len(ranks) * 200), abs=0.01)
    assert got["EX/P0"].consistency == 50.0 and got["EX/none"].accuracy == 100.0


def ticks(spark):
    return spark.createDataFrame([(i, D0 + timedelta(i % 50), i * 1.5) for i in range(500)], "id int, trade_date date, v double")


@pytest.mark.parametrize("step", ["archive_before", "verify_copy", "delete"])
def test_a_move_that_failed_between_its_steps_is_run_again(spark, tmp_path, monkeypatch, step):
    table, archive = str(tmp_path / "table"), str(tmp_path / "archive")
    want = sorted(map(tuple, ticks(spark).collect()))
    tables.write_partitioned(ticks(spark), table)
    ref = D0 + timedelta(60)

    def broken(*_):
        raise RuntimeError("lost")

    if step == "delete":  # only some of the days were dropped
        tables.archive_before(spark.read.parquet(table), archive, ref)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        for d in (3, 9):
            folder = fs_path(f"{table}/trade_date={D0 + timedelta(d)}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    else:
        with monkeypatch.context() as m:
            m.setattr(tables, step, broken)
            with pytest.raises(RuntimeError):
                tables.move_to_archive(spark, table, archive, ref)
        assert spark.read.parquet(table).count() == 500
    for _ in range(2):
        tables.move_to_archive(spark, table, archive, ref)
    left, gone = spark.read.parquet(table), spark.read.parquet(archive)
    assert left.filter(F.col("trade_date") < F.date_sub(F.lit(ref), 30)).count() == 0 and gone.count() == 300
    assert sorted((r.id, r.trade_date, r.v) for r in left.unionByName(gone).collect()) == want


def test_a_copy_that_differs_keeps_the_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    tables.write_partitioned(ticks(spark), table)
    right = tables.archive_before
    monkeypatch.setattr(tables, "archive_before", lambda df, *a: right(df.filter("id <> 1"), *a))
    with pytest.raises(RuntimeError, match="differs"):
        tables.move_to_archive(spark, table, str(tmp_path / "archive"), D0 + timedelta(60))
    assert spark.read.parquet(table).count() == 500
