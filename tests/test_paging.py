import random

from pyspark.sql import functions as F

from tickloom.operators import query as Q


def test_pages_by_key_equal_pages_by_offset(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(5), rnd.choice("abc"), i) for i in range(230)]
    spark.createDataFrame(rows, "d int, t string, id long").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for order in ({"d": True, "t": True, "id": True}, {"d": False, "t": True, "id": False}):
        sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()]
        last, number = None, 0
        while True:
            number += 1
            got = [tuple(r) for r in Q.page_after(df, order, last, 60).collect()]
            assert got == [tuple(r) for r in Q.page(df, sort, number, 60).collect()]
            if not got:
                break
            last = got[-1]
        assert number == 5


def test_the_first_key_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "date_add(date'2024-01-01', cast(id as int)) AS d").write.parquet(str(tmp_path / "t"))
    page = Q.page_after(spark.read.parquet(str(tmp_path / "t")), {"d": True, "id": True}, ("2024-01-04", 3), 2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2024-01-04)" in plan and "TakeOrderedAndProject(limit=2" in plan
    assert [r.id for r in page.collect()] == [4, 5]
