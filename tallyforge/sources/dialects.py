"""Delimited files of several dialects read together: each file has its own separator, header and line numbers.

A file is cut into blocks as Spark reads it. Lines are numbered and quotes counted inside each block; one row a block
then carries to it what lies before: open quotes, number of records, the file's header. So a file of any size is read
by many tasks, and no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = (",", ";")


def _quotes(c: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """arquivo, _block, _at (order inside a block), value."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "^\uFEFF", "").alias("value"))


def _semicolons(head: str) -> Column:
    count = lambda s: F.length(head) - F.length(F.replace(head, F.lit(s), F.lit("")))
    return count(";") > count(",")


def _names(head: str) -> Column:
    bare = F.replace(head, F.lit('"'), F.lit(""))
    return F.transform(F.when(_semicolons(head), F.split(bare, ";")).otherwise(F.split(bare, ",")), lambda n: F.trim(n))


def records(spark: SparkSession, path: str) -> DataFrame:
    """arquivo, linha, texto, cabecalho: one row for each record below the header, numbered from 2 in each file.

    A record goes on in the next line while its quotes are open; line breaks inside are one \\n. Empty lines outside of
    quotes are no records and have no number. A file with an odd number of quotes is read line by line, so that one
    stray quote does not swallow the rest. The header is the first line that is not empty; a byte order mark is dropped.
    Empty files give no rows."""
    lines = _lines(spark, path)
    in_block = Window.partitionBy("arquivo", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_odd", F.coalesce(F.sum(_quotes("value")).over(in_block), F.lit(0)) % 2)

    full = F.col("value") != ""
    blocks = lines.groupBy("arquivo", "_block").agg(
        F.sum(_quotes("value")).alias("q"), F.count_if(full).alias("n"), F.count_if(full & (F.col("_odd") == 0)).alias("even"), F.count_if(full & (F.col("_odd") == 1)).alias("odd"), F.min_by("value", F.when(full, F.col("_at"))).alias("head"),
    )
    # A file has few blocks: one for each split of it.
    before, whole = Window.partitionBy("arquivo").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("arquivo").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumns({"_stray": F.sum("q").over(whole) % 2 == 1, "_open": F.coalesce(F.sum("q").over(before), F.lit(0)) % 2, "cabecalho": F.first("head", ignorenulls=True).over(whole)})
    starts = F.when(F.col("_stray"), F.col("n")).when(F.col("_open") == 0, F.col("even")).otherwise(F.col("odd"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum(starts).over(before), F.lit(0))).select("arquivo", "_block", "_stray", "_open", "_before", "cabecalho")

    x = lines.join(blocks, ["arquivo", "_block"])
    inside = ~F.col("_stray") & ((F.col("_odd") + F.col("_open")) % 2 == 1)
    x = x.withColumn("_inside", inside).withColumn("_starts", full & ~F.col("_inside")).where(F.col("_inside") | F.col("_starts"))
    x = x.withColumn("linha", F.col("_before") + F.count_if("_starts").over(Window.partitionBy("arquivo", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.col("_stray") | (_quotes("value") % 2 == 0)
    one = x.where(F.col("_starts") & ends).select("arquivo", "linha", F.col("value").alias("texto"), "cabecalho")
    # Only records over several lines are put together by a group; their lines may lie in two blocks.
    more = x.where(F.col("_inside") | ~ends).groupBy("arquivo", "linha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda s: s["value"]), "\n").alias("texto"), F.first("cabecalho").alias("cabecalho"))
    return one.unionByName(more).where("linha > 1")


def table(spark: SparkSession, path: str, columns: tuple[str, ...], required: tuple[str, ...] = (), file: str = "arquivo") -> DataFrame:
    """file (its path), linha, _missing and the named columns as trimmed strings, null where blank or absent.

    A file's separator is the one its header has more of (comma, if equal). Header names may not hold separators; of equal names
    the last counts. Records without any content are left out. _missing names required columns that the file lacks."""
    # One number for all files: fields of the widest header. Only the headers leave their tasks.
    heads = _lines(spark, path).where("value <> ''").groupBy("arquivo").agg(F.min_by("value", F.struct("_block", "_at")).alias("head"))
    width = heads.agg(F.max(F.size(_names("head")))).first()[0] or 1
    fields = ", ".join(f"f{k} string" for k in range(width))

    def parsed(sep: str) -> Column:
        return F.from_csv("texto", fields, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})

    def named(v: Column, names: Column) -> Column:
        """The named columns of the record's values, and whether it has any content."""
        found = []
        for c in columns:
            back = F.array_position(F.reverse(names), c).cast("int")
            one = F.trim(F.get(v, F.size(names) - back))
            found.append(F.when((back > 0) & (one != ""), one).alias(c))
        return F.struct(F.exists(v, lambda x: x.isNotNull() & (F.trim(x) != "")).alias("_full"), *found)

    x = records(spark, path).withColumns({"_names": _names("cabecalho"), "_v": F.when(_semicolons("cabecalho"), parsed(";")).otherwise(parsed(","))})
    # In lambdas, so that each record is parsed once however many columns are asked for.
    listed = F.transform(F.array("_v"), lambda s: F.array(*(s[f"f{k}"] for k in range(width))))
    row = F.transform(listed, lambda v: named(v, F.col("_names")))
    missing = F.array_join(F.array_except(F.array(*(F.lit(c) for c in sorted(required))).cast("array<string>"), F.col("_names")), ", ")
    x = x.select(F.col("arquivo").alias(file), "linha", missing.alias("_missing"), F.inline(row))
    return x.where("_full").drop("_full")
