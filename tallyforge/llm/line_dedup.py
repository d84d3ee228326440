"""Line dedup: suffixes of line sequences ranked by distributed prefix doubling, and their repeated runs.

Lines are the pieces between newlines; blank lines (white space only) take no part and always stay. Each
distinct line gets an id, and a document is its sequence of ids. Suffixes are ranked by their first line,
then by twice as many lines in each round: the rank of a suffix and the rank of the one that begins where
its first lines end form a pair, and the distinct pairs are numbered in order over the whole corpus, so
ranks are places in the suffix array. Suffixes whose prefix is unique leave, as no longer prefix of theirs
can repeat; doubling goes on until all have left.

The suffixes of one rank are an LCP interval: they share at least the round's depth of lines. The earliest
one, by document id, content and place, is the interval's original. A suffix that is not the original of its
interval in a round of min_lines or more begins a later copy; its deepest such round gives the source.
Neighbouring suffixes whose sources are neighbours too form one maximal repeated run (start, length, source).
The lines of these runs are deleted. With min_words, one line of so many words (pieces between white space)
is a run by itself: its interval is that of its first rank.

Common lines meet no single task: values are counted before they are dealt out, and keys that hold more than
a HOT-th of all rows (so fewer than HOT) are looked up by broadcast, all others by merging.

DataFrame operations only. Null text has no lines and stays null; empty text stays empty; texts of any length
are taken whole. Ties cannot arise: equal rows are one document. Rows equal in id and text get the same
result each; rows that share an id but not the text, and null ids (before all others), are documents of their
own. Other columns stay as they are, whatever their names, but columns named n_lines and n_removed are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._spark import global_index, written

MIN_LINES = 2
PASSAGE_WORDS = 51  # more than 50 words: a passage, on however few lines
HOT = 1024
_BLANK = " \t\n\u000b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"


def _places(text: Column) -> Column:
    """(place, line) of the lines that are not blank."""
    at = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(at, lambda s: F.trim(s["line"], F.lit(_BLANK)) != "")


def _looked_up(rows: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with known (by, n: how many rows have the key, values; a written table)."""
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    common, rare = F.broadcast(known.where(hot).drop("n")), known.where(~hot).drop("n").hint("merge")
    return rows.join(common, by).unionByName(rows.join(F.broadcast(known.where(hot).select(*by)), by, "left_anti").join(rare, by))


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Replaces the columns `by` by rank, their place among distinct values, and first, the earliest suffix that has
    them; unique ones leave. Values are counted before they are dealt out, so a common one is one row."""
    known = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "k")).alias("first")).where("n > 1")
    known = written(global_index(known, [F.col(c) for c in by], "rank"), "ranks")
    return _looked_up(rows, known, by).drop(*by)


def _later(rows: DataFrame, depth: int) -> DataFrame:
    """Suffixes that are not the earliest of their rank, with the earliest one (from_id, from_h, from_k)."""
    got = rows.where(~F.struct("id", "h", "k").eqNullSafe(F.col("first")))
    return got.select("id", "h", "k", *(F.col("first")[c].alias(f"from_{c}") for c in ("id", "h", "k")), F.lit(depth).alias("depth"))


def runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """id, h (hash of the text), start, length, from_id, from_h, from_start: the maximal repeated runs, in lines
    that are not blank, from 0. Runs of different sources may overlap."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.posexplode(_places(F.col("text"))).alias("k", "s"))
    passage = F.lit(False) if min_words is None else F.regexp_count("s.line", F.lit(_WORD)) >= min_words
    lines = lines.select("id", "h", "k", F.xxhash64("s.line").alias("a"), F.xxhash64("s.line", F.lit(1)).alias("b"), passage.alias("passage"))
    rows = written(_ranked(lines, ["a", "b"]).distinct(), "suffixes")
    found = [] if min_words is None else [_later(rows.where("passage"), 1)]
    depth = 1
    while depth <= min_lines or not rows.isEmpty():
        if depth >= min_lines:
            found.append(_later(rows, depth))
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        before = rows.select("id", "h", "k", F.col("rank").alias("r1"))
        after = rows.select(F.col("id").alias("_id"), F.col("h").alias("_h"), (F.col("k") - step).alias("_k"), F.col("rank").alias("r2"))
        pairs = before.join(after, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("k") == F.col("_k"))).select("id", "h", "k", "r1", "r2")
        rows = written(_ranked(pairs, ["r1", "r2"]), "suffixes")
        depth += step
    later = found[0]
    for more in found[1:]:
        later = later.unionByName(more)
    at = ["from_id", "from_h", "from_k", "depth"]
    best = later.groupBy("id", "h", "k").agg(F.max_by(F.struct(*at), "depth").alias("best")).select("id", "h", "k", *(F.col("best")[c].alias(c) for c in at))
    shift = F.col("from_k") - F.col("k")
    own = Window.partitionBy("id", "h").orderBy("k")
    same = F.lag("from_id").over(own).eqNullSafe(F.col("from_id")) & (F.lag("from_h").over(own) == F.col("from_h")) & (F.lag(shift).over(own) == shift) & (F.lag("k").over(own) == F.col("k") - 1)
    run = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(own)
    return best.withColumn("run", run).groupBy("id", "h", "run", "from_id", "from_h").agg(F.min("k").alias("start"), (F.max(F.col("k") + F.col("depth")) - F.min("k")).alias("length"), F.min("from_k").alias("from_start")).drop("run")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """id, h and copies: the numbers (from 0, among lines not blank) of lines to delete, ascending."""
    gone = runs(docs, min_lines, min_words).select("id", "h", F.sequence("start", F.col("start") + F.col("length") - 1).alias("run"))
    return gone.groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("run")))).alias("copies"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """The rows of docs with later copies of repeated line runs cut from text, and n_lines, n_removed
    (lines that are not blank)."""
    gone = written(later_copies(docs, min_lines, min_words), "copies").hint("merge")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_h"))
    got = own.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h")), "left")
    text = F.col("row")["text"]
    got = got.select("row", "copies", F.split(text, "\n", -1).alias("raw"), F.transform(_places(text), lambda s: s["i"]).alias("places"))
    got = got.withColumn("dead", F.transform("copies", lambda k: F.get(F.col("places"), k)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.col("dead"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col("raw"), i)), "\n")
    text = F.when(F.col("copies").isNull(), text).otherwise(kept)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")  # noqa: E731  size(null) depends on ANSI mode
    columns = [(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return got.select(*columns, size("places").alias("n_lines"), size("copies").alias("n_removed"))


#: min_lines = 2 and min_words = PASSAGE_WORDS.
ORACLE_SQL = r"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank FROM r),
k AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n WHERE NOT blank),
w AS (SELECT doc_id, k, line, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS line2 FROM k),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, k) AS c FROM w WHERE line2 IS NOT NULL),
p AS (SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS c FROM k WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 51),
g AS (SELECT doc_id, k FROM f WHERE c > 1 UNION SELECT doc_id, k + 1 FROM f WHERE c > 1 UNION SELECT doc_id, k FROM p WHERE c > 1),
a AS (SELECT k.doc_id, k.i FROM k JOIN g USING (doc_id, k)),
t AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE a.i IS NULL) AS kept, count(*) FILTER (WHERE NOT blank) AS n_lines, count(a.i) AS n_removed
      FROM n LEFT JOIN a ON a.doc_id = n.doc_id AND a.i = n.i GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
