"""Candidate pairs by equality and band joins; never all pairs of the two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import fixed
from tallyforge.operators.features import prefixed
from tallyforge.operators.lineage import written
from tallyforge.operators.skew import CELL, dealt_join


def days() -> Column:
    return F.abs(F.datediff("b_data_ref", "l_data_ref"))


def _sides(bank: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prefixed(bank, "b_"), prefixed(ledger, "l_")


def equal_value_and_document(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs of equal kind, cents and document digits."""
    b, l = _sides(bank, ledger)
    on = (F.col("b_tipo") == F.col("l_tipo")) & (F.col("b_cents") == F.col("l_cents")) & (F.col("b_doc") == F.col("l_doc"))
    return b.where("b_doc <> ''").join(l.where("l_doc <> ''").hint("merge"), on)


def equal_value(bank: DataFrame, ledger: DataFrame, month: bool = False) -> DataFrame:
    b, l = _sides(bank, ledger)
    on = (F.col("b_tipo") == F.col("l_tipo")) & (F.col("b_cents") == F.col("l_cents"))
    return b.join(l.hint("merge"), on & (F.col("b_month") == F.col("l_month")) if month else on)


def band(bank: DataFrame, ledger: DataFrame, keys: list[str], width: int, cell: int = CELL) -> DataFrame:
    """Pairs with equal keys and dates at most width days apart: dates are cut into buckets of width + 1 days,
    the ledger side goes to three neighbouring buckets, and the exact distance is a residual condition. Buckets of more
    than cell rows are dealt over several tasks."""
    b, l = _sides(bank, ledger)
    slot = lambda c: F.floor(F.unix_date(c) / (width + 1))
    names = [f"_{k}" for k in keys]
    b = b.withColumns({n: F.col(f"b_{k}") for n, k in zip(names, keys, strict=True)} | {"_slot": slot("b_data_ref")})
    l = l.withColumns({n: F.col(f"l_{k}") for n, k in zip(names, keys, strict=True)} | {"_slot": F.explode(F.array(*(slot("l_data_ref") + k for k in (-1, 0, 1))))})
    return dealt_join(b, l, [*names, "_slot"], cell).where(days() <= width).drop(*names, "_slot")


def nearest_smaller(one: DataFrame, many: DataFrame, keys: list[str], width: int, first: int, p: tuple[str, str] = ("b_", "l_")) -> DataFrame:
    """Of each row of one, the first pairs by distance, valor and id with smaller rows of many, equal keys and dates at
    most width days apart, or all if there are fewer; columns are prefixed by p.

    By that order only the first rows of a day by valor and id can be among the first of any row, so others stay out
    before the join. Rows look a few days around first; only those that find too few there look farther."""
    a, z = p
    by_day = Window.partitionBy(*keys, "data_ref").orderBy("valor", "id")
    many = written(prefixed(many.withColumn("_no", F.row_number().over(by_day)).where(F.col("_no") <= first).drop("_no"), z), "many")
    one, out = written(prefixed(one, a), "one"), None
    gap = F.abs(F.datediff(f"{a}data_ref", f"{z}data_ref"))
    on = [F.col(f"{a}{k}") == F.col(f"{z}{k}") for k in keys] + [F.col("_slot") == F.col("_to"), F.col(f"{z}valor") < F.col(f"{a}valor")]
    for days_off in sorted({min(w, width) for w in (0, 3, 12, width)}):
        slot = lambda c: F.floor(F.unix_date(c) / F.lit(days_off + 1))  # noqa: E731, B023
        to = F.explode(F.array(*(slot(f"{z}data_ref") + k for k in ((-1, 0, 1) if days_off else (0,)))))
        met = one.withColumn("_slot", slot(f"{a}data_ref")).join(many.withColumn("_to", to).hint("merge"), on).where(gap <= days_off).drop("_slot", "_to")
        order = Window.partitionBy(f"{a}id").orderBy(gap, f"{z}valor", f"{z}id")
        got = met.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= first)
        if days_off < width:
            got = written(got, "nearest")
            full = got.where(F.col("_no") == first).select(f"{a}id")
            got = got.join(full.hint("merge"), f"{a}id", "left_semi").select(*got.columns)
            one = one.join(full.hint("merge"), f"{a}id", "left_anti").select(*one.columns)
        got = got.drop("_no")
        out = got if out is None else out.unionByName(got)
    return out


def scoring_pairs(bank: DataFrame, ledger: DataFrame, by_root: bool = False) -> DataFrame:
    """All pairs that a score above 0 is possible for: equal value, or equal document near in date; with by_root also
    company numbers of one root near in date, which the month dialect calls compatible."""
    near = band(bank.where("doc <> ''"), ledger.where("doc <> ''"), ["tipo", "root" if by_root else "doc"], fixed.NEAR_DAYS).where("b_cents <> l_cents")
    if by_root:
        near = near.where((F.col("b_doc") == F.col("l_doc")) | (F.length("b_doc") == 14) & (F.length("l_doc") == 14))
    return equal_value(bank, ledger).unionByName(near)


def near_match_band(bank: DataFrame, ledger: DataFrame, cell: int = CELL) -> DataFrame:
    """Equal document root and kind, other value: within 3 days by seven exact dates."""
    b, l = _sides(bank.where("root <> ''"), ledger.where("root <> ''"))
    b = b.withColumns({"_root": F.col("b_root"), "_tipo": F.col("b_tipo"), "_day": F.explode(F.array(*(F.date_add("b_data_ref", k) for k in range(-3, 4))))})
    l = l.withColumns({"_root": F.col("l_root"), "_tipo": F.col("l_tipo"), "_day": F.col("l_data_ref")})
    return dealt_join(b, l, ["_root", "_tipo", "_day"], cell).drop("_root", "_tipo", "_day").where("b_valor <> l_valor")
