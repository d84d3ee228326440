"""Quality rules: decision lists learned from labelled text statistics.

`text_statistics` gives one row of counts per document over its whole text. `learn` grows and prunes
conjunctions of thresholds by sequential covering (grow by information gain on two thirds of the rows,
prune on the rest), and `DecisionList.verdict` turns them into one ordered Spark `CASE WHEN`.

Null texts count as empty: all counts are 0. Repeated rows and ids each get their own row. Columns of
the input other than id and text are not carried; an empty table gives an empty result. Documents
without a label take no part in learning; without usable labels the list is empty and keeps all that
the base rule keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _text
from tallyforge.llm._spark import small_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct"]
MAX_LABELLED = 20_000
WINDOW = 5
_SYMBOLS = b"#*$%&|<>"


def _flags(chars: bytes) -> np.ndarray:
    x = np.zeros(256, np.int64)
    x[list(chars)] = 1
    return x


_LEAD = np.ones(256, np.int64)
_LEAD[0x80:0xC0] = 0
_LEAD[_text._SPACE] = 0
_TABLES = {"word_chars": _LEAD, "n_symbols": _flags(_SYMBOLS), "n_upper": _flags(bytes(range(65, 91))), "n_digits": _flags(b"0123456789"), "n_stops": _flags(b".,;:!?")}


def _first_seen(keys: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each group."""
    own = _text.mix(keys ^ _text.mix(group.astype(np.uint64)))
    return np.bincount(group[np.unique(own, return_index=True)[1]], minlength=n)


def counts(w: _text.Words) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk."""
    n = len(w.first) - 1
    out = {"n_words": np.diff(w.first)}
    for name, flags in _TABLES.items():
        at = np.concatenate([[0], np.cumsum(flags[w.data])])
        out[name] = np.diff(at[w.text_at])
    out["n_distinct"] = _first_seen(w.hash, w.doc, n)
    gram, at = w.grams(WINDOW)
    _, inverse, often = np.unique(_text.mix(gram ^ _text.mix(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    covered = np.zeros(len(w.hash), bool)
    twice = at[often[inverse] > 1]
    for k in range(WINDOW):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    ends = np.concatenate([np.flatnonzero(w.data == 10), w.text_at[1:]])
    row = np.concatenate([np.searchsorted(w.text_at, ends[: len(ends) - n], "right") - 1, np.arange(n)])
    order = np.lexsort((ends, row))
    ends, row = ends[order], row[order]
    start = np.empty_like(ends)
    start[1:] = ends[:-1] + 1
    fresh = np.flatnonzero(np.diff(row, prepend=-1))
    start[fresh] = w.text_at[row[fresh]]
    has = np.searchsorted(w.start, start) < np.searchsorted(w.start, ends)
    start, ends, row = start[has], ends[has], row[has]
    keys = _text._rolling(_text._BYTE[w.data], start, ends)
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _first_seen(keys, row, n)
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and COUNTS (long) of every row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _text.chunks(b.column(1)):
                got = counts(w)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo).cast(pa.int64()), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["id", *COUNTS])

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return got.withColumnRenamed("id", id_col)


#: Ratios that rules may test; each as (numerator, denominator).
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"), "upper_per_char": ("n_upper", "word_chars"), "digits_per_char": ("n_digits", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"), "distinct_words": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)) if b else F.col(a).cast("double")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class Rule:
    """All of (feature, '<=' or '>=', threshold) hold; precision on the rows it was pruned on."""

    tests: list[tuple[str, str, float]]
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.tests:
            out &= x[f] <= t if op == "<=" else x[f] >= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            out = out & (feature(f) <= t if op == "<=" else feature(f) >= t)
        return out


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, and what none rejects is kept."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """Number of the first rule that holds, or null: one ordered conditional expression."""
        out = None
        for k, r in enumerate(self.rules):
            out = F.when(r.column(), F.lit(k)) if out is None else out.when(r.column(), F.lit(k))
        return F.lit(None).cast("int") if out is None else out

    def verdict(self) -> Column:
        return self.fired().isNull()


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    tests, live = [], np.ones(len(bad), bool)
    while len(tests) < most and bad[live].sum() and (~bad[live]).sum():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        best = (1e-9, None)
        for f, v in x.items():
            v, y = v[live], bad[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            last = np.flatnonzero(np.append(np.diff(v) > 0, True))
            p, n = np.cumsum(y)[last], np.cumsum(~y)[last]
            for op, pp, nn in (("<=", p, n), (">=", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.nanargmax(gain))
                if gain[k] > best[0]:
                    if op == "<=":
                        t = v[last[k]] if k + 1 == len(last) else (v[last[k]] + v[last[k] + 1]) / 2
                    else:
                        t = (v[last[k]] + v[last[k] + 1]) / 2
                    best = (gain[k], (f, op, float(t)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule([best[1]], 0).holds(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, max_rules: int = 12, max_tests: int = 4, seed: int = 7) -> DecisionList:
    """Sequential covering. A rule is taken while it is right on min_precision of the held part that it
    covers; else learning ends. The rows that a rule covers leave both parts."""
    out, left = DecisionList(), np.ones(len(bad), bool)
    held = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    while len(out.rules) < max_rules and bad[left & ~held].sum() >= 5:
        part = lambda m: ({f: v[m] for f, v in x.items()}, bad[m])
        tests = _grow(*part(left & ~held), max_tests)
        xp, yp = part(left & held)
        best = None
        for k in range(len(tests), 0, -1):
            on = Rule(tests[:k], 0).holds(xp)
            p, n = int(yp[on].sum()), int((~yp[on]).sum())
            worth = (p - n) / (p + n) if p + n else -1
            if best is None or worth > best[0]:
                best = (worth, k, p, n)
        if best is None or best[2] < 2 or best[2] < min_precision * (best[2] + best[3]):
            break
        out.rules.append(Rule(tests[: best[1]], best[2] / (best[2] + best[3])))
        left &= ~out.rules[-1].holds(x)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, label_col: str = "quality") -> DecisionList:
    """Learns from at most max_labelled labelled documents: those whose id has the smallest hash. Only
    this fit is bounded; statistics and verdicts cover every row. Rows that the base rule rejects are
    left out, as the list judges only the others."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_labelled ids
    got = text_statistics(some).join(F.broadcast(known), "doc_id").where(~base_failed())
    # One row for each labelled id, however often it occurs, so that what is collected is bounded.
    got = got.groupBy("doc_id").agg(F.min(F.struct("_label", *(feature(f).alias(f) for f in FEATURES))).alias("x")).select("doc_id", "x.*").toPandas().sort_values("doc_id")
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["_label"].to_numpy() == 0) if len(got) else DecisionList()


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (the number of the rule that rejects, or null), kept."""
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules.fired()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that the rules keep, row by row and without a shuffle: docs has a column text."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("text")
            for lo, hi, w in _text.chunks(b.column(at)):
                got = counts(w)
                yield pa.record_batch([*(c.slice(lo, hi - lo) for c in b.columns), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=[*names, *(f"_own_{c}" for c in COUNTS)])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    got = docs.mapInArrow(run, ", ".join([*kinds, *(f"_own_{c} long" for c in COUNTS)]))
    stats = got.select(F.struct(*(f"`{c}`" for c in names)).alias("_row"), *(F.col(f"_own_{c}").alias(c) for c in COUNTS))  # own columns of docs can't stand for the counts
    return stats.where(~base_failed() & rules.verdict()).select("_row.*")
