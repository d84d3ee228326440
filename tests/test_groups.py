"""Exact groups: rounds by choices that change each other, and only the first pairs of each row."""

import datetime as dt
import random
import time
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import candidates, rounds

PAIRS = "one long, many long, turn long, sub string, seen long, place long, cents long, target long, mark int"


def test_rows_without_sums_take_no_rounds(spark, monkeypatch):
    tables, write = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name: tables.append(name) or write(df, name))
    # 15 rows that want the same 25 even values and sum to odd ones.
    rows = [(b, l, b, "", l, l, 2 * l + 100, 2001 + 2 * b, 0) for b in range(15) for l in range(25)]
    assert rounds.exact_groups(spark.createDataFrame(rows, PAIRS), 20, True).count() == 0
    assert len(tables) < 10


def test_first_pairs_are_enough(spark, monkeypatch):
    monkeypatch.setattr(rounds, "SPARE", 0)
    r = random.Random(0)
    side = lambda n, values: [(k, 1, dt.date(1995, 3, 1) + dt.timedelta(r.randrange(9)), Decimal(r.choice(values))) for k in range(n)]
    ones, many, limit = side(14, [9, 12, 15, 21]), side(40, [3, 4, 5, 7, 8]), 4
    place = lambda b, l: (abs((b[2] - l[2]).days), l[3], l[0])
    used, want = set(), []
    for b in sorted(ones, key=lambda b: (b[2], b[0])):
        free = sorted((l for l in many if l[0] not in used and l[3] < b[3] and place(b, l)[0] <= 5), key=lambda l: place(b, l))[:limit]
        got = [free[i][0] for i in rounds.exact_subset([int(l[3]) for l in free], int(b[3]))] if len(free) > 1 else []
        used.update(got)
        want += [(b[0], got)] if got else []
    assert len(want) > 3
    kinds = "id long, g int, data_ref date, valor decimal(18,2)"
    one, other = spark.createDataFrame(ones, kinds), spark.createDataFrame(many, kinds)
    asked = []

    def pairs(k):
        asked.append(k)
        turn, seen = "struct(b_data_ref, b_id) AS turn", "struct(l_data_ref, l_id) AS seen"
        return candidates.nearest_smaller(one, other, ["g"], 5, k).selectExpr("b_id AS one", "l_id AS many", turn, "'' AS sub", seen, "struct(abs(datediff(b_data_ref, l_data_ref)), l_valor, l_id) AS place", "cast(l_valor AS long) AS cents", "cast(b_valor AS long) AS target", "0 AS mark")

    got = rounds.exact_groups(pairs, limit, True).collect()
    assert sorted((x["one"], [m["id"] for m in x["many"]]) for x in got) == sorted(want)
    assert len(asked) > 1


def test_sums_of_twenty_values_need_no_search(spark):
    r = random.Random(3)
    for _ in range(2000):
        cents = [r.randrange(1, r.choice([6, 40, 500])) for _ in range(r.randrange(2, 12))]
        target = sum(r.sample(cents, r.randrange(1, len(cents) + 1))) + r.choice([0, 0, 1])
        assert rounds._least_subset(cents, target) == rounds.exact_subset(cents, target)
    # 150 rows that all have a sum: a search through all sums takes some 0.5 s for each.
    rows = []
    for _ in range(150):
        cents = [r.randrange(1, 5_000_000) for _ in range(20)]
        rows.append((cents, sum(r.sample(cents, 10))))
    began = time.time()
    got = spark.createDataFrame(rows, "cents array<long>, target long").select("cents", "target", rounds.subset_of(F.col("cents"), F.col("target")).alias("at")).collect()
    assert time.time() - began < 10
    assert all(sum(x["cents"][i] for i in x["at"]) == x["target"] for x in got)


def test_groups_known_to_first_come_need_no_rounds(spark, monkeypatch):
    r, tables, write = random.Random(4), [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name: tables.append(name) or write(df, name))
    # 40 rows of a group that all want the same: 40 rounds, if each round tells one.
    pairs = [(g * 100 + b, g * 100 + l, b, l if g else r.randrange(50) * 100 + l, g) for g in range(3) for b in range(40) for l in range(35) if g or r.random() < 0.3]
    used, last, want = set(), None, []
    for g, b, l, _, _ in sorted(((p[4], p[0], p[1], p[2], p[3]) for p in pairs), key=lambda p: (p[0], p[3], p[4], p[2])):
        if b != last and l not in used:
            used.add(l), want.append((b, l))
            last = b
    df = spark.createDataFrame(pairs, "b long, l long, turn long, wish long, g int")
    assert sorted(map(tuple, rounds.first_come(df, ["g"]).collect())) == sorted(want)
    assert len(tables) < 5
    # Larger groups go by rounds and give the same.
    monkeypatch.setattr(rounds, "STREAM", 500)
    assert sorted(map(tuple, rounds.first_come(df, ["g"]).collect())) == sorted(want)
    assert len(tables) > 20


def test_first_subsets_of_many_values_equal_the_search():
    r = random.Random(8)
    for n, most, target in [(60, 30, 900), (45, 9, 200), (70, 4, 275), (50, 40, 41), (40, 2, 79), (300, 5000, 4000)] * 12:
        cents = [r.randrange(1, most) * 2 for _ in range(n)]
        want = rounds.exact_subset(cents, target)
        assert rounds._first_subset(cents, target) == want
        fits = [v for v in cents if v <= target]
        assert [fits[i] for i in rounds._subset_by_bits(fits, target)] == [cents[i] for i in want]
    # A sum that no beginning of 36 values has.
    cents = [1000] * 40 + [7, 11]
    assert rounds._first_subset(cents, 1018) == [0, 40, 41]


def test_without_a_limit_all_rows_are_tried(spark, monkeypatch):
    r = random.Random(2)
    # 60 rows that all want the same; those that sum to a row may be the last.
    values = [2 * r.randrange(500, 900) for _ in range(58)] + [3, 5]
    targets = [8, 1008 + 2 * 900, 6001, 5000, 7001, 40000, 9999]
    used, want = set(), []
    for b, t in enumerate(targets):
        free = [l for l in range(60) if l not in used and values[l] < t]
        got = [free[i] for i in rounds.exact_subset([values[l] for l in free], t)] if len(free) > 1 else []
        used.update(got)
        want += [(b, got)] if got else []
    assert any(max(got) > 40 for _, got in want)
    pairs = spark.createDataFrame([(b, l, b, "", l, l, values[l], t, 0) for b, t in enumerate(targets) for l in range(60) if values[l] < t], PAIRS)
    asked = []

    def first(k):
        asked.append(k)
        return pairs.withColumn("_no", F.expr("row_number() over (partition by one order by place)")).where(F.col("_no") <= k).drop("_no")

    for given in (pairs, first):
        assert sorted((x["one"], [m["id"] for m in x["many"]]) for x in rounds.exact_groups(given, None, True).collect()) == want
    assert len(asked) > 1
    # As a sorted stream, and with groups that are too large for it, the same.
    grouped = lambda k: (pairs if k is None else first(k)).withColumn("group", F.lit(1))
    for most in (rounds.STREAM, 100):
        monkeypatch.setattr(rounds, "STREAM", most)
        assert sorted((x["one"], [m["id"] for m in x["many"]]) for x in rounds.all_groups(grouped).collect()) == want
