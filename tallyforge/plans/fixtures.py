"""Bank and ledger facts projected from orders and customers, and the same as SQL.

The class of an order is its key modulo 13; classes differ in date, document, text, value or number of ledger
rows, so that every rule of matching is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table may be one file of one row group: dealt out, as texts are normalised from it. Customers grow with orders,
    # so they are not sent to all tasks by the driver.
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return o.join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 13).alias("c"), F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("o_orderstatus") == "F", "ENTRADA").otherwise("SAIDA").alias("tipo"), F.col("o_totalprice").cast(MONEY).alias("v"),
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("000100")).alias("doc"), F.col("c_nationkey").cast("long").alias("empresa_id"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("who"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, data_ref, tipo, valor, descricao, documento, empresa_id."""
    b = _base(spark, sf_dir).where("c <> 10")
    text = F.when(F.col("c") == 12, "PAGAMENTO CAIXA ECONOMICA FEDERAL").otherwise(F.concat(F.lit("PIX ENVIADO "), F.col("who")))
    return b.select(F.col("k").alias("id"), F.col("d").alias("data_ref"), "tipo", F.col("v").alias("valor"), text.alias("descricao"), F.when(F.col("c").isin(4, 5, 12), "").otherwise(F.col("doc")).alias("documento"), "empresa_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, data_ref, tipo, valor, favorecido, descricao, documento, empresa_id."""
    b = _base(spark, sf_dir).where("c <> 9")
    n = F.explode(F.sequence(F.lit(1), F.when(F.col("c") == 8, 3).when(F.col("c") == 11, 2).otherwise(1)))
    days = F.create_map(*(F.lit(x) for p in {1: 2, 2: 20, 3: 20, 5: 2, 6: 10, 7: 1, 12: 3}.items() for x in p))
    third = F.expr("cast(v * 100 as bigint) div 3")
    b = b.select("*", n.alias("n"))
    part = (F.when(F.col("n") < 3, third).otherwise((F.col("v") * 100).cast("long") - 2 * third)).cast("decimal(20,0)") / 100
    value = F.when(F.col("c") == 8, part.cast(MONEY)).when(F.col("c") == 7, (F.col("v") + F.lit(10)).cast(MONEY)).otherwise(F.col("v")).cast(MONEY)
    doc = F.when(F.col("c").isin(4, 5, 12), "").when(F.col("c") == 6, F.concat(F.substring("doc", 1, 8), F.lit("000200"))).otherwise(F.col("doc"))
    return b.select(
        (F.col("k") * 10 + F.col("n")).alias("id"), F.date_add("d", F.coalesce(F.element_at(days, F.col("c").cast("int")), F.lit(0))).alias("data_ref"), "tipo", value.alias("valor"),
        F.when(F.col("c").isin(3, 5), "zzqx wwkk").otherwise(F.col("who")).alias("favorecido"), F.when(F.col("c") == 12, "DARF imposto federal").otherwise("nota fiscal").alias("descricao"), doc.alias("documento"), "empresa_id",
    )


#: The same two facts for DuckDB; queries put their SELECT after it.
SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_orderkey % 13 AS c, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'F' THEN 'ENTRADA' ELSE 'SAIDA' END AS tipo,
         o_totalprice::DECIMAL(18,2) AS v, lpad(o_custkey::VARCHAR, 8, '0') || '000100' AS doc, c_nationkey::BIGINT AS empresa_id, c_mktsegment || ' ' || c_name AS who
  FROM orders JOIN customer ON o_custkey = c_custkey),
bank AS (
  SELECT k AS id, d AS data_ref, tipo, v AS valor, CASE WHEN c = 12 THEN 'PAGAMENTO CAIXA ECONOMICA FEDERAL' ELSE 'PIX ENVIADO ' || who END AS descricao,
         CASE WHEN c IN (4, 5, 12) THEN '' ELSE doc END AS documento, empresa_id
  FROM base WHERE c <> 10),
ledger AS (
  SELECT k * 10 + n AS id, CAST(d + INTERVAL (CASE c WHEN 1 THEN 2 WHEN 2 THEN 20 WHEN 3 THEN 20 WHEN 5 THEN 2 WHEN 6 THEN 10 WHEN 7 THEN 1 WHEN 12 THEN 3 ELSE 0 END) DAY AS DATE) AS data_ref, tipo,
         CAST(CASE WHEN c = 8 THEN CAST((CASE WHEN n < 3 THEN (v * 100)::BIGINT // 3 ELSE (v * 100)::BIGINT - 2 * ((v * 100)::BIGINT // 3) END) * 0.01 AS DECIMAL(18,2)) WHEN c = 7 THEN v + 10 ELSE v END AS DECIMAL(18,2)) AS valor,
         CASE WHEN c IN (3, 5) THEN 'zzqx wwkk' ELSE who END AS favorecido, CASE WHEN c = 12 THEN 'DARF imposto federal' ELSE 'nota fiscal' END AS descricao,
         CASE WHEN c IN (4, 5, 12) THEN '' WHEN c = 6 THEN left(doc, 8) || '000200' ELSE doc END AS documento, empresa_id
  FROM base, range(1, 4) r(n) WHERE c <> 9 AND n <= CASE c WHEN 8 THEN 3 WHEN 11 THEN 2 ELSE 1 END)
"""
