"""Queries on files that are written from the given tables and read back, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values
from tallyforge.operators.lineage import shared_dir
from tallyforge.plans.fixtures import SQL, ledger, read
from tallyforge.plans.queries import query
from tallyforge.sources import files


def _printed(spark: SparkSession, sf: str) -> str:
    """The ledger as files of two dialects in one folder: separator and order of columns differ, texts hold separators,
    quotes and line breaks, and some rows are wrong."""
    at = f"{shared_dir(spark)}/tallyforge/files-{uuid.uuid4().hex}"
    x = ledger(spark, sf).select(
        F.col("id"), F.col("id").cast("string").alias("identificador_externo"), F.when(F.col("id") % 17 == 0, "x").otherwise(F.col("empresa_id").cast("string")).alias("empresa_id"),
        F.when(F.col("id") % 19 == 0, "?").when(F.col("tipo") == "ENTRADA", " Receita").otherwise("despesa").alias("tipo_movimento"), F.translate(F.format_number("valor", 2), ",.", ".,").alias("valor"),
        F.when(F.col("id") % 23 != 0, F.date_format("data_ref", "dd/MM/yyyy")).alias("data_pagamento"), F.col("favorecido").alias("fornecedor_cliente"), F.concat(F.lit('nota; "'), "descricao", F.lit('"\n, fim')).alias("descricao"),
    )
    names = x.columns[1:]
    x.where("id % 2 = 0").select(*names).write.option("header", True).option("sep", ";").option("escape", '"').csv(f"{at}/a")
    x.where("id % 2 = 1").select(*reversed(names)).write.option("header", True).option("escape", '"').csv(f"{at}/b")
    return f"{at}/*"


@query(SQL + """SELECT id::VARCHAR AS identificador_externo, empresa_id, data_ref, tipo, valor, favorecido AS fornecedor_cliente, 'nota; "' || descricao || '"' || chr(10) || ', fim' AS descricao, 'ABERTO' AS status
 FROM ledger WHERE id % 17 <> 0 AND id % 19 <> 0 AND id % 23 <> 0""")
def source_ledger_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger files of two dialects, read together."""
    return files.ledger_csv(spark, _printed(spark, sf))[0].select("identificador_externo", "empresa_id", "data_ref", "tipo", F.col("valor").cast(values.MONEY).alias("valor"), "fornecedor_cliente", "descricao", "status")


@query(SQL + """SELECT id::VARCHAR AS identificador_externo, CASE WHEN id % 17 <> 0 AND id % 19 <> 0 THEN 'data_lancamento_ou_data_pagamento' ELSE concat_ws(',', CASE WHEN id % 19 = 0 THEN 'tipo_movimento' END, CASE WHEN id % 17 = 0 THEN 'empresa_id' END) END AS erro
 FROM ledger WHERE id % 17 = 0 OR id % 19 = 0 OR id % 23 = 0""")
def source_ledger_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the rows of ledger files that are left out."""
    return files.ledger_csv(spark, _printed(spark, sf))[1].select("identificador_externo", F.col("_error").alias("erro"))


@query("""SELECT o_orderkey::VARCHAR AS documento, o_orderdate::DATE AS data_ref, CASE WHEN o_orderstatus = 'F' THEN 'ENTRADA' ELSE 'SAIDA' END AS tipo_movimento, o_totalprice::DECIMAL(18,2) AS valor, (o_orderkey % 7)::INTEGER AS pagina,
 CASE WHEN o_orderkey % 2 = 0 THEN 'BANCO A' ELSE 'BANCO PADRAO' END AS banco_nome, CASE WHEN o_orderkey % 2 = 0 THEN '001' END AS banco_codigo, CASE WHEN o_orderkey % 2 = 0 THEN 'CORA' ELSE 'CSV_LEGADO' END AS layout, CASE WHEN o_orderkey % 2 = 0 THEN '77' ELSE '9' END AS conta FROM orders""")
def source_bank_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bank files of two folders: some tell their account in each row, some leave it to the defaults."""
    at = f"{shared_dir(spark)}/tallyforge/files-{uuid.uuid4().hex}"
    told = {"banco_nome": "BANCO A", "banco_codigo": "001", "layout": "CORA", "conta": "77"}
    o = read(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"), F.when(F.col("o_orderstatus") == "F", "ENTRADA").otherwise("SAIDA").alias("tipo_movimento"), F.col("o_totalprice").cast(values.MONEY).alias("valor"),
        F.lit("pix; a").alias("descricao"), F.col("o_orderkey").alias("documento"), (F.col("o_orderkey") % 7).alias("pagina"), *(F.when(F.col("o_orderkey") % 2 == 0, v).alias(c) for c, v in told.items()),
    )
    for k in (0, 1):
        o.where(f"o_orderkey % 2 = {k}").drop("o_orderkey").write.option("header", True).option("sep", ";").csv(f"{at}/p={k}")
    a, b = (files.bank_files(spark, f"{at}/p={k}", {"banco_nome": "BANCO PADRAO", "conta": "9"})[0] for k in (0, 1))
    return a.unionByName(b).select("documento", "data_ref", "tipo_movimento", F.col("valor").cast(values.MONEY).alias("valor"), "pagina", "banco_nome", "banco_codigo", "layout", "conta")


@query("""SELECT 'SISTEMA-XLS:' || left(sha256(l_orderkey::VARCHAR), 16) || ':' || lpad((l_linenumber + 1)::VARCHAR, 4, '0') AS identificador_externo, l_shipdate::DATE AS data_lancamento, CASE WHEN l_returnflag = 'R' THEN 'SAIDA' ELSE 'ENTRADA' END AS tipo,
 l_extendedprice::DECIMAL(18,2) AS valor, 'P' || l_partkey AS fornecedor_cliente, NULLIF(l_returnflag, 'N') AS categoria, 'SISTEMA.xls' AS sistema_origem, 'ABERTO' AS status FROM lineitem WHERE l_linestatus = 'F'""")
def source_sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as rows of spreadsheets, a file an order."""
    sign = F.when(F.col("l_linestatus") != "F", "0.00").otherwise(F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), F.col("l_extendedprice").cast(values.MONEY).cast("string")))
    rows = read(spark, sf, "lineitem").select(
        F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"), (F.col("l_linenumber") + 1).cast("int").alias("row_no"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("data_realizacao"), sign.alias("valor_realizado"), F.concat(F.lit(" P"), F.col("l_partkey").cast("string")).alias("favorecido"),
        F.lit(None).cast("string").alias("cnpj_cpf"), F.lit(" ").alias("descricao"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("conta"), F.lit("").alias("centro_custo"),
    )
    return files.sheet_ledger(rows).select("identificador_externo", "data_lancamento", "tipo", F.col("valor").cast(values.MONEY).alias("valor"), "fornecedor_cliente", "categoria", "sistema_origem", "status")
