"""Order-dependent matchings as rounds of joins and aggregations, equal to a loop over all rows.

Each function keeps what a loop in order of `turn` (or of `key`) would do, but decides in each round all rows on which
no earlier row can have a say. Rounds end when nothing is left to decide; their number is the longest chain of rows that
depend on each other, not the number of rows. Where groups are known and small, sorted streams do without rounds. `turn` differs for each row that chooses.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.lineage import remove, written

#: How many pairs beyond those that are tried a row gets at first, for rows that others take.
SPARE = 12
#: How many pairs are tried at first where no limit is given: so many amounts nearly always have some sum.
FIRST = 28
#: The most pairs of a group that one task takes as a stream.
STREAM = 10_000_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The loop over pairs (group, b, l) that come by group, turn and wish; what is used is kept for a group at a time."""
    group, used, last = None, set(), None
    for x in batches:
        out = []
        for g, b, l in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if g != group:
                group, used, last = g, set(), None
            if b != last and l not in used:
                used.add(l)
                last = b
                out.append((b, l))
        yield pa.RecordBatch.from_arrays([pa.array(c, x.schema.field(k).type) for k, c in enumerate(zip(*out, strict=True) if out else ([], []), 1)], names=["b", "l"])


def first_come(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """b, l from pairs (b, l, turn, wish): each b, in order of turn, takes what is left of its l with the least wish.

    With by (columns of pairs that no two rows which want the same partner differ in) groups of up to STREAM pairs come
    as sorted streams, in one pass. Otherwise, and for larger groups, by deferred acceptance: every b asks for its best l,
    which keeps the earliest; pairs of an l with later rows go. As all l prefer by turn alone, what is stable in the end
    is what the loop does."""
    pairs, held, done = written(pairs, "pairs"), None, None
    if by:
        large = written(pairs.groupBy(*by).count().where(F.col("count") > STREAM).select(*by), "large")
        few = pairs.join(large, by, "left_anti").select(F.xxhash64(*by).alias("group"), "b", "l", "turn", "wish")
        few = few.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "turn", "wish").select("group", "b", "l")
        done = written(few.mapInArrow(_in_order, few.select("b", "l").schema), "taken")
        if large.isEmpty():
            remove(pairs, large)
            return done
        rest = written(pairs.join(large, by, "left_semi").select("b", "l", "turn", "wish"), "pairs")
        remove(pairs, large)
        pairs = rest
    while True:
        left = pairs
        if held is not None:
            first = held.groupBy("l").agg(F.min("turn").alias("first"))
            left = pairs.join(first.hint("merge"), "l", "left").where(F.col("first").isNull() | (F.col("turn") <= F.col("first")))
        best = left.groupBy("b").agg(F.min(F.struct("wish", "l", "turn")).alias("best")).select("b", "best.l", "best.turn")
        now = written(best.withColumn("first", F.min("turn").over(Window.partitionBy("l"))), "held")
        remove(held)
        held = now
        if held.where("turn <> first").isEmpty():
            remove(pairs)
            got = held.select("b", "l")
            return got if done is None else got.unionByName(done)


def best_first(pairs: DataFrame) -> DataFrame:
    """b, l from pairs (b, l, key): pairs by ascending key (no two are equal), each b and l once. A pair that is the
    least of both its rows is taken at once, whatever happens elsewhere."""
    left, out = written(pairs, "pairs"), None
    while True:
        least = lambda c: F.min("key").over(Window.partitionBy(c))
        got = written(left.withColumn("_b", least("b")).withColumn("_l", least("l")).where("key = _b AND key = _l").select("b", "l"), "taken")
        out = got if out is None else out.unionByName(got)
        rest = written(left.join(got.select("b").hint("merge"), "b", "left_anti").join(got.select("l").hint("merge"), "l", "left_anti"), "pairs")
        remove(left)
        left = rest
        if left.isEmpty():
            return out


def exact_subset(cents: list[int], target: int) -> list[int]:
    """Places of the values that sum to target, or []. Sums are reached in the given order and keep the first value
    that reached them, so the answer depends on the order alone."""
    last: dict[int, int] = {0: -1}
    for i, v in enumerate(cents):
        for s in [s for s in last if s + v <= target and s + v not in last]:
            last[s + v] = i
        if target in last and target:
            out, s = [], target
            while s:
                out.append(last[s])
                s -= cents[last[s]]
            return out[::-1]
    return []


def _least_subset(cents: list[int], target: int, most: int = 1 << 62) -> list[int] | None:
    """exact_subset of values above 0. Its answer is the subset whose last place is the least, then whose last but one is,
    and so on, that is, the least number of which the places are bits; sums of both halves meet, a root of all each.
    None if a half has more than most sums or 60 values."""
    halves, middle = [], len(cents) // 2
    for part in (cents[:middle], cents[middle:]):
        sums, bits = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i, v in enumerate(part):
            more = sums + v
            keep = more <= target
            sums, bits = np.concatenate([sums, more[keep]]), np.concatenate([bits, bits[keep] | 1 << i])
            if v in part[:i]:  # of equal sums the least number counts
                at = np.sort(np.unique(sums, return_index=True)[1])
                sums, bits = sums[at], bits[at]
            if len(sums) > most or len(part) > 60:
                return None
        halves.append((sums, bits))
    (low, low_bits), (high, high_bits) = halves
    order = np.argsort(low, kind="stable")
    rest = target - high
    at = np.minimum(np.searchsorted(low, rest, sorter=order), len(low) - 1)
    met = np.flatnonzero(low[order[at]] == rest)
    if not len(met) or not target:
        return []
    bits = int(low_bits[order[at[met[0]]]]) | int(high_bits[met[0]]) << middle
    return [i for i in range(len(cents)) if bits >> i & 1]


def _subset_by_bits(cents: list[int], target: int) -> list[int]:
    """exact_subset of values above 0, with a bit for each sum up to target. Equal values that follow each other count as
    one step: how many of them a sum needs at least is told by the sums before. Sums are kept before every 16th step,
    those between are made again on the way back."""
    mask, steps, at = (2 << target) - 1, [], 0
    for v, same in groupby(cents):
        n = len(list(same))
        steps.append((at, v, n))
        at += n

    def after(sums: int, v: int, n: int) -> int:
        k, n = 1, min(n, target // v)
        while n:
            k = min(k, n)
            sums |= sums << k * v & mask
            n, k = n - k, 2 * k
        return sums

    def needed(sums: int, total: int, v: int, n: int) -> int:
        n = min(n, total // v)
        rest = sums >> total - n * v  # bit k * v: what n - k of them leave is reached
        return next((c for c in range(1, n + 1) if rest >> (n - c) * v & 1), 0)

    sums, kept, last = 1, [], -1
    for i, (_, v, n) in enumerate(steps):
        if i % 16 == 0:
            kept.append(sums)
        if needed(sums, target, v, n):
            last = i
            break
        sums = after(sums, v, n)
    out: list[int] = []
    while last >= 0:
        first = last - last % 16
        before = [kept[first // 16]]
        for _, v, n in steps[first:last]:
            before.append(after(before[-1], v, n))
        for (at, v, n), sums in zip(reversed(steps[first : last + 1]), reversed(before), strict=True):
            if not sums >> target & 1:
                c = needed(sums, target, v, n)
                out += range(at + c - 1, at - 1, -1)
                target -= c * v
        last = first - 1 if target else -1
    return out[::-1]


def _first_subset(cents: list[int], target: int) -> list[int]:
    """exact_subset of however many values above 0. Its answer lies in the least beginning that has any, so ever longer
    ones are tried by halves; where these grow too large, all values with a bit for each sum up to target, or by search
    for targets of 2^28 and more."""
    # Of equal values the first are taken, and no more than target holds.
    at, times = [], Counter()
    for i, v in enumerate(cents):
        times[v] += 1
        if times[v] * v <= target:
            at.append(i)
    fits = [cents[i] for i in at]
    small = target < 1 << 28
    done, step = 16, 4
    while True:
        n = min(done + step, len(fits))
        got: list[int] | None = []
        if sum(fits[:n]) >= target:
            got = _least_subset(fits[:n], target, 1 << 18 if small else 1 << 26)
        if got is None and step > 1:
            step //= 2  # as far as halves go: long before, nearly any target has a sum
        elif got is None:
            return [at[i] for i in (_subset_by_bits(fits, target) if small else exact_subset(fits, target))]
        elif got or n == len(fits):
            return [at[i] for i in got]
        else:
            done, step = n, step if step < 4 else max(4, n // 4)


def _subset(cents: list[int], target: int) -> list[int]:
    """exact_subset by the way that suits the values."""
    if not cents or min(cents) > 0 and sum(cents) < target:
        return []
    # Values that are not above 0 and huge ones are left to the search.
    return exact_subset(cents, target) if min(cents) <= 0 or max(cents) > 1 << 50 else _first_subset(cents, target)


def subset_of(cents: Column, target: Column) -> Column:
    """exact_subset of array and target, as places from 0."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for many, one in parts:
            out = []
            for m, t in zip(many, one, strict=True):
                out.append([] if m is None else _subset([int(x) for x in m], int(t)))
            yield pd.Series(out, dtype=object)

    return run(cents, target)


def _choices(pairs: DataFrame, limit: int | None, cut: bool) -> DataFrame:
    """one, turn, sum (null: none), more (whether there may be other rows to try), of each `one` by its pairs."""
    # Few bytes, but searched one by one: as many tasks as asked for.
    pairs, group = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "one"), Window.partitionBy("one", "sub")
    tried = pairs.withColumn("_no", F.row_number().over(group.orderBy("place"))).withColumn("_n", F.count("*").over(group)).withColumn("_seen", F.min("seen").over(group))
    rows = F.array_sort(F.collect_list(F.struct("place", F.col("many").alias("id"), "mark", "cents")))
    over = F.col("_n") > limit if limit else F.lit(False)
    more = over | F.coalesce(F.col("_n") >= F.col("asked"), F.lit(False))
    tried = tried.where(F.col("_no") <= limit if limit else F.lit(True)).groupBy("one", "sub").agg(rows.alias("rows"), *(F.first(c).alias(c) for c in ("turn", "target", "asked", "_n", "_seen")))
    tried = tried.where("_n > 1").withColumn("_places", subset_of(F.when(~over | F.lit(cut), F.transform("rows", lambda r: r["cents"])), F.col("target")))
    sums = F.when(F.size("_places") > 0, F.transform("_places", lambda i: F.struct(F.col("rows")[i]["id"].alias("id"), F.col("rows")[i]["mark"].alias("mark"))))
    return tried.withColumn("_sum", sums).groupBy("one").agg(F.first("turn").alias("turn"), F.min_by("_sum", F.when(F.col("_sum").isNotNull(), F.col("_seen"))).alias("sum"), F.max(more).alias("more"))


def _free(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs whose `many` no earlier row takes."""
    return pairs.join(taken.hint("merge"), "many", "left").where(F.col("by").isNull() | (F.col("by") >= F.col("turn"))).drop("by")


_SUM = pa.list_(pa.struct([("id", pa.int64()), ("mark", pa.int32())]))


def _sums_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The loop over pairs (group, one, target, many, cents, mark) that come by group, turn and place; the pairs of one row
    and what is used in a group are kept at a time."""
    used: set = set()
    group, out = None, []
    told = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], _SUM)], names=["one", "many"])
    for (g, one, target), rows in groupby((r for x in batches for r in zip(*(c.to_pylist() for c in x.columns), strict=True)), itemgetter(0, 1, 2)):
        if g != group:
            group, used = g, set()
        free = [r for r in rows if r[3] not in used]
        if len(free) > 1 and (got := [free[i] for i in _subset([r[4] for r in free], target)]):
            used.update(r[3] for r in got)
            out.append((one, [{"id": r[3], "mark": r[5]} for r in got]))
        if len(out) > 1000:
            yield told()
            out.clear()
    yield told()


def all_groups(pairs: Callable[[int | None], DataFrame]) -> DataFrame:
    """exact_groups without a limit, from a function that gives the first k pairs of each `one`, or for None all, with
    group, in which no two rows that want the same `many` differ. Groups of up to STREAM pairs come as sorted streams, in
    one pass; larger ones go by rounds."""
    every = written(pairs(None), "pairs")
    large = written(every.groupBy("group").count().where(F.col("count") > STREAM).select("group"), "large")
    few = every.join(large.hint("merge"), "group", "left_anti").repartition(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    few = few.sortWithinPartitions("group", "turn", "place").select("group", "one", "target", "many", "cents", "mark")
    done = written(few.mapInArrow(_sums_in_order, "one long, many array<struct<id:long,mark:int>>"), "sums")
    many = large.isEmpty()
    remove(every)
    if many:
        remove(large)
        return done
    return done.unionByName(exact_groups(lambda k: pairs(k).join(large.hint("merge"), "group", "left_semi").drop("group"), None, True))


def exact_groups(pairs: DataFrame | Callable[[int], DataFrame], limit: int | None, cut: bool) -> DataFrame:
    """one, many (array of structs id, mark, in order of place) from pairs (one, many, turn, sub, seen, place, cents,
    target, mark): each `one`, in order of turn, takes the first exact sum of its free `many`, tried by `sub` in order
    of their least `seen`. Of more than `limit`, the first by place are tried if cut, else none; None: all are tried.

    All rows choose at once, first as if all were free, then again those whose rows others take earlier or no longer,
    until no choice changes. A row's choice depends on earlier rows alone, so what stands is what the loop does; rounds
    are as many as the longest chain of choices that change each other, and most rows have no sum to begin with.

    With cut, pairs may be a function of k that gives the first k pairs by place of each `one`, or all if there are
    fewer. Rows of which k pairs are not enough in the end (less than limit are free, or without limit, no sum is found)
    get twice as many, and the rounds go on; as what stands does not depend on where they begin, that is the same."""
    k = (limit or FIRST) + SPARE
    told = lambda: (pairs(k) if callable(pairs) else pairs).withColumn("asked", F.lit(k if callable(pairs) else None).cast("int"))
    every = written(told(), "pairs")
    first = written(_choices(every, limit, cut), "choices")
    # Who has no sum and no other rows to try will never have one, as rows only go.
    left = written(every.join(first.where(F.col("sum").isNotNull() | F.col("more")).select("one").hint("merge"), "one", "left_semi"), "pairs")
    chosen = written(first.where(F.col("sum").isNotNull()).select("one", "turn", "sum"), "chosen")
    remove(every, first)
    taken = None
    while True:
        now = written(chosen.select("turn", F.explode("sum").alias("m")).groupBy(F.col("m.id").alias("many")).agg(F.min("turn").alias("by")), "taken")
        if taken is None:
            other = now.select("many", F.col("by").alias("_least"))
        else:
            was = taken.withColumnRenamed("by", "_was")
            other = now.join(was.hint("merge"), "many", "full").where(~F.col("by").eqNullSafe(F.col("_was"))).select("many", F.least("by", "_was").alias("_least"))
        stirred = written(left.join(other.hint("merge"), "many").where(F.col("_least") < F.col("turn")).select("one").distinct(), "stirred")
        remove(taken)
        taken, fresh = now, left
        if stirred.isEmpty():
            remove(stirred)
            if not callable(pairs):
                break
            full = left.groupBy("one").agg(F.count("*").alias("n"), F.first("asked").alias("asked")).where(F.col("n") >= F.col("asked")).select("one")
            if limit:
                free = _free(left, taken).groupBy("one").agg(F.count("*").alias("free"))
                full = full.join(free.hint("merge"), "one", "left").where(F.coalesce("free", F.lit(0)) < limit).select("one")
            else:
                full = full.join(chosen.select("one").hint("merge"), "one", "left_anti")
            stirred = written(full, "stirred")
            if stirred.isEmpty():
                remove(stirred)
                break
            k *= 2
            fresh = written(told().join(stirred.hint("merge"), "one", "left_semi"), "pairs")
            rest = written(left.join(stirred.hint("merge"), "one", "left_anti").unionByName(fresh), "pairs")
            remove(left, fresh)
            left = fresh = rest
        again = _choices(_free(fresh.join(stirred.hint("merge"), "one", "left_semi"), taken), limit, cut).where(F.col("sum").isNotNull()).select("one", "turn", "sum")
        rest = written(chosen.join(stirred.hint("merge"), "one", "left_anti").unionByName(again), "chosen")
        remove(chosen, stirred)
        chosen = rest
    remove(left, taken)
    return chosen.select("one", F.col("sum").alias("many"))
