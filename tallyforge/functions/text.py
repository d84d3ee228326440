"""Text functions as column expressions: all run inside the JVM but `similarity`."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyforge.functions import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _folding() -> tuple[str, str]:
    """Characters below U+2200 whose compatibility form without marks is one ASCII character, and those."""
    one, to = [], []
    for k in range(0xA0, 0x2200):
        c = chr(k)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c and d.isascii():
            one.append(c)
            to.append(d)
    return "".join(one), "".join(to)


FOLD_FROM, FOLD_TO = _folding()


def strip_accents(c: str | Column) -> Column:
    """Accents and marks dropped, compatibility characters folded one to one (ligatures and fractions stay)."""
    return F.regexp_replace(F.translate(_col(c), FOLD_FROM, FOLD_TO), "\\p{M}", "")


def _plain(c: Column) -> Column:
    """c without accents, which pure ASCII does not have."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(strip_accents(c))


def normalize(c: str | Column) -> Column:
    """Lower-case ASCII words separated by single spaces; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(_plain(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+", " "))


def normalize_upper(c: str | Column) -> Column:
    """Upper case without accents, punctuation kept; null gives ''."""
    return F.upper(_plain(F.coalesce(_col(c), F.lit(""))))


def digits(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^0-9]", "")


def doc_root(c: str | Column) -> Column:
    """Digits; of a 14-digit company number the first 8."""
    d = digits(c)
    return F.when(F.length(d) == 14, F.substring(d, 1, 8)).otherwise(d)


def doc_equal(a: str | Column, b: str | Column) -> Column:
    x, y = digits(a), digits(b)
    return (x != "") & (x == y)


def doc_compatible(a: str | Column, b: str | Column) -> Column:
    """Equal, or both company numbers of one root."""
    x, y = digits(a), digits(b)
    return doc_equal(a, b) | ((F.length(x) == 14) & (F.length(y) == 14) & (F.substring(x, 1, 8) == F.substring(y, 1, 8)))


def tokens(norm: str | Column) -> Column:
    """Distinct telling words of a normalised text."""
    words = F.filter(F.split(_col(norm), " "), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$"))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, fixed.IGNORED_TOKENS)))


def categories(toks: str | Column) -> Column:
    """Categories that share a word with the tokens, in order."""
    each = [F.when(F.arrays_overlap(_col(toks), F.array(*map(F.lit, words))), F.lit(name)) for name, words in fixed.CATEGORIES.items()]
    return F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull()))


def contains_term(norm: str | Column, terms: tuple[str, ...]) -> Column:
    """A term of several words is in the text, or a single one is among its words."""
    n = _col(norm)
    single = [t for t in terms if " " not in t]
    out = F.arrays_overlap(F.split(n, " "), F.array(*map(F.lit, single))) if single else F.lit(False)
    for t in terms:
        if " " in t:
            out = out | n.contains(t)
    return (n != "") & out


def is_federal_bank(norm: str | Column) -> Column:
    n = _col(norm)
    return n.contains("caixa economica") | (F.array_contains(F.split(n, " "), "caixa") & n.contains("economic"))


def is_tax(norm: str | Column) -> Column:
    return contains_term(norm, fixed.TAX_TERMS)


def joined(*cols: str | Column) -> Column:
    """Parts that are neither null nor empty, joined by a space."""
    return F.concat_ws(" ", *(F.when(_col(c) != "", _col(c)) for c in cols))


def relation(tok_a: Column, tok_b: Column) -> Column:
    """What two texts share, in words; '' if nothing."""
    cats = F.array_intersect(categories(tok_a), categories(tok_b))
    common = F.array_sort(F.array_intersect(tok_a, tok_b))
    return F.concat_ws(
        "; ",
        F.when(F.size(cats) > 0, F.concat(F.lit("categorias relacionadas: "), F.array_join(F.array_sort(cats), ", "))),
        F.when(F.size(common) > 0, F.concat(F.lit("palavras em comum: "), F.array_join(F.slice(common, 1, 5), ", "))),
    )


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp on normalised texts, 0 if either is empty. Not symmetric: bank text first."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """`ratio` of normalised texts in Arrow batches; equal pairs are computed once a batch."""
    for a, b in parts:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b, strict=True):
            if p not in known:
                known[p] = ratio(*p)
            out.append(known[p])
        yield pd.Series(out, dtype="float64")


