"""Sharding by extendible hashing.

A directory is indexed by the first bits of a hash: 40 bits of the key's MD5, then 20 bits of the row
content's MD5, which part the rows of a hot key. Bytes are summed for cells of the hash, and for each
cell the shortest prefix whose bucket fits the byte limit is its shard; only cells that still do not fit
at the deepest prefix summed so far are split on further bits in another round.

Rows with a null key hash as the key '' with a leading 0 byte would; null contents count 0 bytes. Rows
equal in key and content can't be parted; if they alone pass the limit, they form one shard flagged
oversized, as does a single row beyond the limit. Repeated rows are counted each. Extra columns are not
carried. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._spark import written

BITS = 60
STEP = 8
LIMIT = 1 << 20


def _prefix(h: str | Column, depth: int | Column) -> Column:
    """The first `depth` bits."""
    h = F.col(h) if isinstance(h, str) else h
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def hash_bits(key: str, text: str) -> Column:
    hexed = lambda c, n: F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")
    own = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    return hexed(own, 10) * (1 << 20) + hexed(F.coalesce(F.col(text), F.lit("")), 5)


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, depth, shard (its bits), shard_bytes, oversized, for every row."""
    rows = docs.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(key, text).alias("_h"))
    rows = written(rows, "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(BITS, max(0, (total // limit).bit_length()) + 3)
    parts, lo, live = [], 0, rows
    while True:
        cells = live.groupBy(_prefix("_h", F.lit(deep)).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        depths = F.sequence(F.lit(lo), F.lit(deep))
        tree = cells.select("bytes", F.explode(depths).alias("depth"), "cell")
        tree = tree.groupBy("depth", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"))
        fits = tree.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        own = cells.select("cell", F.explode(depths).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int")))
        leaf = own.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        leaf = written(leaf.select("cell", "leaf.*"), f"directory{deep}")
        parts.append(live.withColumn("cell", _prefix("_h", F.lit(deep))).join(leaf, "cell").drop("cell"))
        if deep == BITS:
            break
        rest = written(live.withColumn("cell", _prefix("_h", F.lit(deep))).join(leaf, "cell", "left_anti").drop("cell"), "oversized")
        if rest.isEmpty():
            break
        live, lo, deep = rest, deep + 1, min(BITS, deep + STEP)
    out = reduce(DataFrame.unionByName, parts)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select(key, "n_bytes", "depth", bits.alias("shard"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


ORACLE_SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 10))::BIGINT * {1 << 20}
         + ('0x' || substr(md5(coalesce(text, '')), 1, 5))::BIGINT AS h
  FROM documents),
d AS (SELECT unnest(range(0, 31)) AS depth),
b AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM h, d GROUP BY ALL),
l AS (SELECT h.doc_id, h.n_bytes, h.h, min(b.depth) AS depth FROM h JOIN b ON b.prefix = h.h >> ({BITS} - b.depth) AND b.shard_bytes <= {LIMIT} GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, l.depth::INTEGER AS depth,
       right(repeat('0', 64) || bin(b.prefix), l.depth::INTEGER) AS shard, b.shard_bytes, false AS oversized
FROM l JOIN b ON b.depth = l.depth AND b.prefix = l.h >> ({BITS} - l.depth)
"""
