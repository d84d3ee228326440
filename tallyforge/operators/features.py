"""Columns that matching needs, computed once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text, values


def _common(df: DataFrame) -> DataFrame:
    return df.withColumns({"cents": values.cents("valor"), "month": F.date_format("data_ref", "yyyy-MM"), "doc": text.digits("documento"), "root": text.doc_root("documento")})


def _once(value: Column, parts: Callable[[Column], dict[str, Column]]) -> Column:
    """A struct of what is derived from value, which is computed once however often the parts name it."""
    return F.transform(F.array(value), lambda x: F.struct(*(c.alias(name) for name, c in parts(x).items())))[0]


def bank_features(bank: DataFrame) -> DataFrame:
    """Adds cents, month, doc, root, norm, toks, federal."""
    out = _common(bank).withColumn("_f", _once(text.normalize("descricao"), lambda n: {"norm": n, "toks": text.tokens(n), "federal": text.is_federal_bank(n)}))
    return out.select("*", "_f.*").drop("_f")


def ledger_features(ledger: DataFrame) -> DataFrame:
    """Adds cents, month, doc, root, norm (payee and description), toks, tax, payee."""
    out = _common(ledger).withColumn("payee", text.normalize("favorecido"))
    out = out.withColumn("_f", _once(text.normalize(text.joined("favorecido", "descricao")), lambda n: {"norm": n, "toks": text.tokens(n), "tax": text.is_tax(n)}))
    return out.select("*", "_f.*").drop("_f")


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])
