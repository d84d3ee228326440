import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import fixed
from tallyforge.operators import candidates, skew

ROW = "id long, data_ref date, tipo string, root string, valor decimal(18,2)"


def facts(spark, n, seed):
    """A third of all rows has one root; some have none or a null one."""
    g = random.Random(seed)
    rows = [(k, dt.date(1995, 1, 1) + dt.timedelta(g.randrange(120)), g.choice(["ENTRADA", "SAIDA", "SAIDA"]), g.choice(["hot", "hot", "", None] + [f"r{g.randrange(40)}" for _ in range(3)]), Decimal(g.randrange(5))) for k in range(n)]
    return rows, spark.createDataFrame(rows, ROW)


def test_hot_buckets_give_each_pair_once(spark):
    (br, b), (lr, l) = facts(spark, 400, 1), facts(spark, 600, 2)
    for width in (0, 3, 45):
        want = sorted((x[0], y[0]) for x in br for y in lr if x[2] == y[2] and x[3] is not None and x[3] == y[3] and abs((x[1] - y[1]).days) <= width)
        for cell in (3, 25, skew.CELL):
            got = candidates.band(b, l, ["tipo", "root"], width, cell)
            assert sorted((r["b_id"], r["l_id"]) for r in got.collect()) == want
            assert all(c[:2] in ("b_", "l_") for c in got.columns)
    want = sorted((x[0], y[0]) for x in br for y in lr if x[2] == y[2] and x[3] and x[3] == y[3] and abs((x[1] - y[1]).days) <= 3 and x[4] != y[4])
    for cell in (2, skew.CELL):
        assert sorted((r["b_id"], r["l_id"]) for r in candidates.near_match_band(b, l, cell).collect()) == want


def test_groups_of_a_hot_key_are_bounded(spark):
    """One root of 200,000 rows on one side: no group of the join holds more than about a cell of it."""
    left = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("b"))
    right = spark.range(50).select(F.lit("hot").alias("k"), F.col("id").alias("l"))
    hot = skew.hot_keys(left, right, ["k"], 5000).collect()
    assert [(r["_lp"], r["_rp"]) for r in hot] == [(40, 1)]
    got = skew.dealt_join(left, right, ["k"], 5000)
    assert got.count() == 200_000 * 50 and got.select("b", "l").distinct().count() == 200_000 * 50
    sizes = left.groupBy(F.pmod(F.xxhash64("k", "b"), F.lit(40))).count().agg(F.max("count")).first()[0]
    assert sizes < 1.2 * 5000


def test_empty_sides_and_null_keys(spark):
    b, l = facts(spark, 30, 3)[1], facts(spark, 30, 4)[1]
    assert candidates.band(b.where("false"), l, ["tipo", "root"], fixed.NEAR_DAYS, 1).count() == 0
    assert candidates.band(b, l.where("false"), ["tipo", "root"], fixed.NEAR_DAYS, 1).count() == 0
    none = b.withColumn("root", F.lit(None).cast("string"))
    assert candidates.band(none, l, ["tipo", "root"], fixed.NEAR_DAYS, 1).count() == 0


def test_a_month_is_cut_before_the_shuffle(spark):
    """The first rows of a month are a partial top k in the plan, not a sort of whole groups."""
    from pyspark.sql import Window

    l = facts(spark, 50, 5)[1]
    top = l.withColumn("_no", F.row_number().over(Window.partitionBy("tipo", "root").orderBy("data_ref", "id"))).where(f"_no <= {fixed.MONTH_FALLBACK_LIMIT}")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
