"""Source divergence audit: how far the sources of a language are apart in their use of its common terms.

A term is a maximal run of ASCII letters (A-Z lower-cased) and characters beyond ASCII. Two passes: the first counts
in how many documents of a language each term occurs, exactly, and keeps those with `least_docs` or more. The second
recounts occurrences of the kept terms with an Aho-Corasick automaton whose patterns are the terms between spaces, over
texts in which all other characters are spaces. The vocabulary of a language grows with the corpus, so it is dealt by
hash into shards of about SHARD_BYTES, each an automaton of its own; where a language has several, the terms of its
texts are dealt alike, joined for each batch and source. Texts of a shard go to groups of about GROUP_BYTES, however
large a language or source is, and shard and texts meet by a join of keys, never by a broadcast.

The counts are sparse postings (lang, source, term, n > 0). A source's share of a term it lacks is the same for all
its absent terms, so a pair of sources needs only the terms that either holds: blocks of terms and sources become small
matrices, whose differences from that constant are summed over the blocks. All arithmetic is on integers and decimals.

Null text, lang or source is ''. Every lang and source that occurs has its pairs, also without terms or kept terms
(value 0 where its language has none). Ties of value go by the UTF-8 order of items. Repeated rows count each time;
ids are not read. Texts are taken whole, however long (one text is one row of a group). Other columns are not carried,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._spark import small_batches, written

SHARD_BYTES, GROUP_BYTES = 1 << 20, 16 << 20
TERM_BLOCK, SOURCE_BLOCK = 4096, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS_A_TERM = 5

#: Bytes of a text as the automaton sees it: letters in lower case, spaces for all else of ASCII.
_SEEN = bytes(c if c >= 0x80 else c | 0x20 if 65 <= c & ~0x20 <= 90 else 0x20 for c in range(256))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def vocabulary(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, term, docs: the terms in at least so many documents of a language."""
    terms = F.array_distinct(F.split(F.translate("text", UPPER, LOWER), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"))
    each = _texts(docs).select("lang", F.explode(terms).alias("term")).where("term <> ''")
    return each.groupBy("lang", "term").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def _pieces(docs: DataFrame) -> DataFrame:
    """lang, shard, salt, source, text of docs with the columns shards and salts: whole texts where the language has
    one shard, else the terms of each shard, joined for the sources of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()  # tasks start at different salts
        for b in batches:
            out: dict[tuple[str, int, str], list[bytes]] = defaultdict(list)
            salts = {}
            for lang, source, text, shards, many in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text", "shards", "salts")), strict=True):
                seen, salts[lang] = text.encode().translate(_SEEN), many
                if shards == 1:
                    out[lang, 0, source].append(seen)
                else:
                    for t in seen.split():
                        out[lang, zlib.crc32(t) % shards, source].append(t)
            if out:
                rows = []
                for (lang, shard, source), found in out.items():
                    turn += 1
                    rows.append((lang, shard, turn % salts[lang], source, b" ".join(found)))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "shard", "salt", "source", "text"])

    return docs.mapInArrow(run, "lang string, shard int, salt int, source string, text binary")


def _recount(texts: pa.Table, terms: pa.Table) -> pa.Table:
    """lang, source, term, n of a group: occurrences of the shard's terms in the group's texts."""
    words = terms.column("term").to_pylist()
    sums: dict[str, np.ndarray] = {}
    if words and len(texts):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(words):
            automaton.add_word(f" {t.encode().decode('latin-1')} ", i)  # one character a byte, as in the texts
        automaton.make_automaton()
        for source, text in zip(texts.column("source").to_pylist(), texts.column("text"), strict=True):
            seen = f" {text.as_py().decode('latin-1')} "
            found = np.bincount(np.fromiter((i for _, i in automaton.iter(seen)), np.int64), minlength=len(words))
            sums[source] = sums[source] + found if source in sums else found
    lang = texts.column("lang")[0].as_py() if len(texts) else ""
    rows = [(lang, s, words[i], int(n[i])) for s, n in sums.items() for i in np.flatnonzero(n)]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "term", "n"])


def postings(docs: DataFrame, vocab: DataFrame, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """lang, source, term, n: how often each kept term occurs in a source, where it does."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _texts(docs)
    size = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    plan = vocab.groupBy("lang").agg(F.sum(F.octet_length("term") + 2).alias("size")).join(size, "lang")
    plan = plan.select("lang", F.ceil(F.col("size") / shard_bytes).cast("int").alias("shards"), "bytes")
    plan = written(plan.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.col("shards") / group_bytes)).cast("int")).drop("bytes"), "plan")
    pieces = _pieces(docs.join(plan, "lang"))
    terms = vocab.join(plan, "lang").select("lang", F.pmod(F.crc32(F.col("term").cast("binary")), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "term")
    keys = ["lang", "shard", "salt"]
    counts = pieces.groupBy(*keys).cogroup(terms.groupBy(*keys)).applyInArrow(_recount, "lang string, source string, term string, n long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000000000).cast("decimal(10,0)") * wide(count + PARTS_A_TERM), wide(total + PARTS_A_TERM * terms)).cast("long") + 1


def _differences(g: pa.Table) -> pa.Table:
    """Of a block of terms and two blocks of sources: lang, a, b and by how much the terms that occur there move their
    distance from that of sources without any; a from the lower block, or a < b within one."""
    g = g.combine_chunks()
    names, row = np.unique(np.array(g.column("source").to_pylist(), object), return_inverse=True)
    _, col = np.unique(np.array(g.column("term").to_pylist(), object), return_inverse=True)
    none, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    none[row], block[row] = g.column("none").to_numpy(), g.column("own").to_numpy()
    m = np.repeat(none[:, None], col.max() + 1, 1)
    m[row, col] = g.column("p").to_numpy()
    low, high = g.column("low")[0].as_py(), g.column("high")[0].as_py()
    a, b, moved = [], [], []
    for i in np.flatnonzero(block == low):
        j = np.arange(i + 1, len(names)) if low == high else np.flatnonzero(block == high)
        d = np.abs(m[j] - m[i]).sum(1) - m.shape[1] * np.abs(none[j] - none[i])
        a += [names[i]] * len(j)
        b += list(names[j])
        moved += d.tolist()
    return pa.table([pa.array([g.column("lang")[0].as_py()] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(moved, pa.int64())], names=["lang", "a", "b", "moved"])


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language by distance; part `term`:
    the first `ranks` terms that the source uses more than its language does."""
    vocab = written(vocabulary(docs, least_docs), "vocabulary")
    found = written(postings(docs, vocab, shard_bytes, group_bytes), "postings")
    kept = vocab.groupBy("lang").agg(F.count("*").alias("v"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _texts(docs).groupBy("lang", "source").agg(F.count("*").alias("docs")).join(kept, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    # Without kept terms there is no share; the divisor of 1 is never seen in a result.
    none = share(F.lit(0), F.when(F.col("v") > 0, F.col("total")).otherwise(1), F.col("v"))
    groups = written(groups.withColumn("none", none).withColumn("own_blocks", F.count("*").over(Window.partitionBy("lang"))), "groups")
    all_of = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("v").alias("v"))

    used = written(found.join(groups.drop("own_blocks"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))), "shares")
    whole = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(all_of, "lang").select("lang", "term", share(F.col("n"), F.col("all"), F.col("v")).alias("q"))
    terms = used.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # Blocks of sources are by hash; a posting goes to every pair of blocks that holds its own.
    many = F.ceil(F.col("own_blocks") / SOURCE_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("source"), many).cast("int")
    tiles = used.join(groups.select("lang", "source", "own_blocks"), ["lang", "source"]).withColumn("own", own).withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / TERM_BLOCK)))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1))).select("lang", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "source", "term", "p", "none")
    moved = tiles.groupBy("lang", "block", "low", "high").applyInArrow(_differences, "lang string, a string, b string, moved long").groupBy("lang", "a", "b").agg(F.sum("moved").alias("moved"))
    moved = written(moved, "pairs")
    both = moved.unionByName(moved.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "moved"))
    # The report itself has a row for each two sources of a language.
    one = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("na"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("nb"))
    pairs = one.join(two, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), (F.col("v") * F.abs(F.col("na") - F.col("nb")) + F.coalesce("moved", F.lit(0))).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= ranks))


def oracle_sql(least_docs: int = 30, ranks: int = 50) -> str:
    p = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v)"
    return f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {least_docs}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN n USING (lang, source) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, {p.format("coalesce(n.n, 0)", "total")} AS p FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, {p.format("n", "total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM g GROUP BY lang) USING (lang)),
f AS (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y USING (lang) LEFT JOIN f ON f.lang = x.lang AND f.a = x.source AND f.b = y.source WHERE x.source <> y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= {ranks}
"""
