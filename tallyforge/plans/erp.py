"""Queries on the ERP's tables, which are laid over the given orders and dimensions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values
from tallyforge.operators import erp
from tallyforge.plans.fixtures import ledger, read
from tallyforge.plans.fixtures import SQL as FACTS
from tallyforge.plans.queries import query

FIRST, LAST = "1996-01-01", "1998-12-31"
_D = f"BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"

#: Each table of the ERP, in SQL that both engines read: flags that are null, negative, zero and missing values,
#: payments without entry, entries without payment, dimensions without a row, payments of two transfers.
TABLES = {
    "pagamentos": """SELECT l_orderkey * 10 + l_linenumber AS cd_pagamento, l_orderkey AS cd_lancamento, CASE WHEN l_linenumber = 7 THEN NULL ELSE d END AS dt_realizacao, d AS dt_vencimento,
 CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN CAST(0 AS DECIMAL(18,2)) WHEN l_linenumber = 4 THEN CAST(-v AS DECIMAL(18,2)) ELSE v END AS nr_realizado, CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN NULL ELSE v END AS nr_pagamento,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE v END AS nr_previsto, s % 30 AS cd_banco, f AS ds_tipo, f = 'R' AS sn_previsto
 FROM (SELECT l_orderkey, l_linenumber, min(CAST(l_shipdate AS DATE)) AS d, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS v, min(l_suppkey) AS s, min(l_returnflag) AS f FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x""",
    "lancamentos": """SELECT o_orderkey AS cd_lancamento, o_custkey % 27 AS cd_empresa, o_custkey AS cd_fornecedor, o_orderkey % 160 AS cd_conta, o_custkey % 30 AS cd_centro, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dt_emissao, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS ds_tipo,
 CAST(o_orderkey AS VARCHAR(20)) AS ds_documento, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS ds_historico, o_orderkey % 2 = 0 AS sn_fechado, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(18,2)) AS nr_nota_liquido, CAST(o_totalprice AS DECIMAL(18,2)) AS nr_nota_bruto FROM {orders} WHERE o_orderkey % 11 <> 0""",
    "empresas": "SELECT n_nationkey AS cd_empresa, n_name AS ds_empresa, concat(n_name, ' LTDA') AS ds_razao, lpad(CAST(n_nationkey AS VARCHAR(20)), 14, '0') AS ds_cnpj FROM {nation}",
    "fornecedores": "SELECT s_suppkey AS cd_fornecedor, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS ds_fornecedor, concat(s_name, ' SA') AS ds_razao, lpad(CAST(s_suppkey AS VARCHAR(20)), 14, '0') AS ds_cnpj FROM {supplier}",
    "contas": "SELECT c_custkey AS cd_conta, c_name AS ds_conta, c_custkey % 6 AS cd_grupo FROM {customer} WHERE c_custkey < 150",
    "contas_grupos": "SELECT r_regionkey AS cd_grupo, CASE WHEN r_regionkey IN (0, 3) THEN 'RECEITAS' ELSE r_name END AS ds_grupo, CASE WHEN r_regionkey = 3 THEN NULL ELSE r_regionkey IN (1, 2) END AS sn_despesa FROM {region}",
    "centro_custos": "SELECT n_nationkey AS cd_centro, n_name AS ds_centro FROM {nation}",
    "bancos": "SELECT n_nationkey AS cd_banco, concat('BANCO ', n_name) AS ds_banco, CASE WHEN n_nationkey = 4 THEN NULL ELSE (n_nationkey * 3) % 28 END AS cd_empresa FROM {nation}",
    "bancos_transfere": """SELECT o_orderkey * k AS cd_transferencia, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dt_conciliacao, CAST(NULL AS DATE) AS dt_lancamento, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dt_emissao, CAST(o_orderdate AS DATE) AS dt_previsao,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 15 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS nr_valor, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority END AS ds_historico, o_custkey % 28 AS cd_banco_src, o_orderkey % 26 AS cd_banco_dst, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * 10 + 1 END AS cd_pagamento, o_custkey % 25 AS cd_centro
 FROM {orders} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT -1) y WHERE o_orderkey % 7 = 0 AND (k = 1 OR o_orderkey % 14 = 0)""",
}
_GIVEN = ("lineitem", "orders", "customer", "supplier", "nation", "region")
SQL = "WITH " + ",\n".join(f"{n} AS ({q.format(**{g: g for g in _GIVEN})})" for n, q in TABLES.items())

#: What a payment is worth, and what each key of a payment or entry stands for: one table a dimension.
_KEYS = f"""due AS (
  SELECT cd_pagamento, cd_lancamento, cd_banco, dt_realizacao, dt_vencimento, ds_tipo AS tipo_pagamento, sn_previsto, worth::DECIMAL(18,2) AS valor
  FROM (SELECT *, coalesce(nr_realizado, nr_pagamento, nr_previsto, 0) AS worth FROM pagamentos) WHERE dt_realizacao {_D}),
entry AS (SELECT * EXCLUDE (ds_tipo, nr_nota_liquido, nr_nota_bruto), ds_tipo AS tipo_lancamento FROM lancamentos),
firm AS (SELECT cd_empresa, ds_empresa, ds_razao AS empresa_razao, ds_cnpj AS empresa_cnpj FROM empresas),
payee AS (SELECT cd_fornecedor, ds_fornecedor, ds_razao AS fornecedor_razao, ds_cnpj AS fornecedor_cnpj FROM fornecedores),
account AS (SELECT * EXCLUDE (cd_grupo) FROM contas LEFT JOIN contas_grupos USING (cd_grupo)),
till AS (SELECT cd_banco, ds_banco FROM bancos),
link AS (SELECT cd_pagamento, cd_transferencia FROM bancos_transfere)"""
_PAID = f"""{_KEYS}, pays AS (
  SELECT * EXCLUDE (cd_fornecedor) FROM entry JOIN due USING (cd_lancamento)
  LEFT JOIN link USING (cd_pagamento) LEFT JOIN till USING (cd_banco) LEFT JOIN account USING (cd_conta) LEFT JOIN centro_custos USING (cd_centro) LEFT JOIN payee USING (cd_fornecedor) LEFT JOIN firm USING (cd_empresa)
  WHERE valor <> 0)"""
_DAYS = "list_filter([dt_conciliacao, dt_lancamento, dt_emissao, dt_previsao], lambda d: d IS NOT NULL)[1]"
_ENDS = " ".join(f"LEFT JOIN (SELECT cd_banco AS cd_banco_{key}, ds_banco AS banco_{end}, cd_empresa AS empresa_{end}, ds_empresa AS unidade_{end}, ds_razao AS razao_{end}, ds_cnpj AS cnpj_{end} FROM bancos LEFT JOIN empresas USING (cd_empresa)) USING (cd_banco_{key})" for key, end in (("dst", "destino"), ("src", "origem")))
_MOVED = f"""moves AS (
  SELECT * FROM (SELECT * EXCLUDE (dt_conciliacao, dt_lancamento, dt_emissao, dt_previsao), {_DAYS} AS data_movimento FROM bancos_transfere) {_ENDS} WHERE nr_valor <> 0 AND data_movimento {_D})"""
_ROWS = """rows_ AS (SELECT 'CLINUX:PAGAMENTO:' || cd_pagamento AS identificador_externo, cd_empresa, ds_empresa AS unidade, coalesce(dt_emissao, dt_realizacao) AS data_lancamento, dt_vencimento, dt_realizacao AS data_pagamento, CASE WHEN sn_despesa THEN 'SAIDA' WHEN NOT sn_despesa OR tipo_lancamento IN ('F', 'U') THEN 'ENTRADA' ELSE 'SAIDA' END AS tipo,
 abs(valor)::DECIMAL(18,2) AS valor, coalesce(ds_fornecedor, fornecedor_razao) AS fornecedor_cliente, ds_documento AS documento, fornecedor_cnpj AS cnpj_cpf, nullif(CASE WHEN ds_banco IS NULL THEN coalesce(ds_historico, '') ELSE trim(coalesce(ds_historico, '') || ' | Banco Clinux: ' || ds_banco) END, '') AS descricao,
 ds_conta AS categoria, ds_centro AS centro_custo, 'CLINUX' AS sistema_origem, ds_grupo AS grupo, cd_transferencia IS NOT NULL AS eh_transferencia FROM pays
 UNION ALL SELECT 'CLINUX:TRANSFERENCIA:' || cd_transferencia || ':' || w, CASE WHEN w = 'SAIDA_ORIGEM' THEN empresa_origem ELSE empresa_destino END, CASE WHEN w = 'SAIDA_ORIGEM' THEN unidade_origem ELSE unidade_destino END, data_movimento, data_movimento, data_movimento, CASE WHEN w = 'SAIDA_ORIGEM' THEN 'SAIDA' ELSE 'ENTRADA' END,
 abs(nr_valor)::DECIMAL(18,2), 'TRANSFERENCIA ENTRE CONTAS', cd_transferencia::VARCHAR, NULL, 'TRANSFERENCIA ENTRE CONTAS | ' || coalesce(banco_origem, 'origem') || ' -> ' || coalesce(banco_destino, 'destino') || coalesce(' | ' || ds_historico, ''), 'TRANSFERENCIA ENTRE CONTAS', NULL, 'CLINUX_TRANSFERENCIA', 'TRANSFERENCIA ENTRE CONTAS', true
 FROM moves CROSS JOIN (VALUES ('SAIDA_ORIGEM'), ('ENTRADA_DESTINO')) v(w))"""
_ALL = f"{SQL}, {_PAID}, {_MOVED}, {_ROWS} "
_REALISED = f"""{SQL}, {_KEYS}, r AS (
  SELECT CASE WHEN ds_empresa IS NOT NULL THEN cd_empresa END AS cd_empresa, ds_empresa, nr_realizado, nr_pagamento, nr_previsto, ds_grupo, sn_despesa IS TRUE AS despesa
  FROM pagamentos JOIN entry USING (cd_lancamento) LEFT JOIN account USING (cd_conta) LEFT JOIN firm USING (cd_empresa) WHERE dt_realizacao {_D}) """


def tables(spark: SparkSession, sf: str) -> erp.Tables:
    given = {g: read(spark, sf, g) for g in _GIVEN}
    return {n: spark.sql(q, **{g: d for g, d in given.items() if f"{{{g}}}" in q}) for n, q in TABLES.items()}


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return erp.ledger(erp.payments(t, FIRST, LAST), erp.transfers(t, FIRST, LAST))


@query(f"{SQL}, {_PAID} SELECT * FROM pays")
def erp_payments(spark: SparkSession, sf: str) -> DataFrame:
    return erp.payments(tables(spark, sf), FIRST, LAST).drop("cd_fornecedor", "cd_grupo")


@query(f"{SQL}, {_PAID} SELECT cd_pagamento, min(cd_transferencia) AS cd_transferencia, any_value(valor) AS valor FROM pays GROUP BY cd_pagamento")
def erp_payments_once(spark: SparkSession, sf: str) -> DataFrame:
    return erp.once(erp.payments(tables(spark, sf), FIRST, LAST)).select("cd_pagamento", "cd_transferencia", "valor")


@query(f"{SQL}, {_PAID} SELECT cd_pagamento, cd_empresa, valor FROM pays WHERE cd_empresa IN (3, 4, 5) AND cd_pagamento > 5000")
def erp_payments_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return erp.payments(tables(spark, sf), FIRST, LAST, companies=[3, 4, 5], above=5000).select("cd_pagamento", "cd_empresa", "valor")


@query(f"{SQL}, {_MOVED} SELECT * FROM moves")
def erp_transfers(spark: SparkSession, sf: str) -> DataFrame:
    return erp.transfers(tables(spark, sf), FIRST, LAST)


@query(f"{SQL}, {_MOVED} SELECT cd_transferencia, nr_valor FROM moves WHERE (empresa_origem IN (3, 6) OR empresa_destino IN (3, 6)) AND cd_transferencia > 700")
def erp_transfers_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return erp.transfers(tables(spark, sf), FIRST, LAST, companies=[3, 6], above=700).select("cd_transferencia", "nr_valor")


@query(_ALL + "SELECT * FROM rows_")
def erp_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf)


@query(_ALL + "SELECT cd_empresa, tipo, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS total, coalesce(sum(valor) FILTER (WHERE tipo = 'ENTRADA' AND sistema_origem = 'CLINUX' AND grupo = 'RECEITAS' AND NOT eh_transferencia), 0)::DECIMAL(28,2) AS faturamento_bruto FROM rows_ GROUP BY cd_empresa, tipo")
def erp_import_totals(spark: SparkSession, sf: str) -> DataFrame:
    return erp.import_totals(_ledger(spark, sf))


_SUMS = {"faturamento_bruto": "sistema_origem = 'CLINUX' AND tipo = 'ENTRADA' AND grupo = 'RECEITAS'", "entradas_sem_transferencia": "sistema_origem = 'CLINUX' AND tipo = 'ENTRADA'", "saidas_sem_transferencia": "sistema_origem = 'CLINUX' AND tipo = 'SAIDA'", "transferencia_entrada": "sistema_origem = 'CLINUX_TRANSFERENCIA' AND tipo = 'ENTRADA'", "transferencia_saida": "sistema_origem = 'CLINUX_TRANSFERENCIA' AND tipo = 'SAIDA'"}


@query(_ALL + "SELECT cd_empresa, unidade, count(*) FILTER (WHERE sistema_origem = 'CLINUX') AS pagamentos, count(*) FILTER (WHERE sistema_origem = 'CLINUX_TRANSFERENCIA') AS transferencias, " + ", ".join(f"coalesce(sum(valor) FILTER (WHERE {c}), 0)::DECIMAL(28,2) AS {n}" for n, c in _SUMS.items()) + " FROM rows_ GROUP BY cd_empresa, unidade")
def erp_unit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return erp.unit_totals(_ledger(spark, sf))


@query(_REALISED + "SELECT CASE WHEN despesa THEN 'SAIDA' ELSE 'ENTRADA' END AS tipo_movimento, count(*) AS qtd, sum(nr_realizado)::DECIMAL(28,2) AS total FROM r WHERE coalesce(nr_realizado, 0) <> 0 GROUP BY 1")
def audit_realised_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return erp.audit_realised(tables(spark, sf), FIRST, LAST)[0]


@query(_REALISED + "SELECT cd_empresa, ds_empresa, count(*) AS qtd, sum(nr_realizado)::DECIMAL(28,2) AS total_realizado, (sum(nr_realizado) FILTER (WHERE ds_grupo = 'RECEITAS' AND NOT despesa))::DECIMAL(28,2) AS faturamento_bruto FROM r WHERE coalesce(nr_realizado, 0) <> 0 GROUP BY cd_empresa, ds_empresa")
def audit_realised_by_unit(spark: SparkSession, sf: str) -> DataFrame:
    return erp.audit_realised(tables(spark, sf), FIRST, LAST)[1]


@query(_REALISED + "SELECT count(*) AS qtd, sum(coalesce(nr_pagamento, nr_previsto, 0))::DECIMAL(28,2) AS total_fallback FROM r WHERE coalesce(nr_realizado, 0) = 0 AND coalesce(nr_pagamento, nr_previsto, 0) <> 0")
def audit_realised_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return erp.audit_realised(tables(spark, sf), FIRST, LAST)[2]


@query(f"{SQL}, {_KEYS} SELECT coalesce(tipo_lancamento, '') AS tipo_lancamento, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS soma, min(valor) AS menor, max(valor) AS maior, count_if(valor < 0)::BIGINT AS negativos FROM due JOIN entry USING (cd_lancamento) WHERE valor <> 0 GROUP BY entry.tipo_lancamento")
def audit_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return erp.audit_kinds(tables(spark, sf), FIRST, LAST)


#: Each payment with an entry, entry without payment and transfer has one reason or none; all reasons are told.
_REASONS = f"""v AS (
  SELECT CASE WHEN dt_realizacao {_D} THEN CASE coalesce(nr_realizado, nr_pagamento, nr_previsto, 0) WHEN 0 THEN 'pagamentos_no_periodo_com_valor_zero' ELSE 'pagamentos_importaveis' END
    WHEN dt_realizacao IS NULL AND dt_vencimento {_D} AND coalesce(nr_pagamento, nr_previsto, 0) <> 0 THEN 'pagamentos_sem_data_realizada_com_vencimento_no_periodo' END AS motivo,
    CASE WHEN dt_realizacao IS NULL THEN coalesce(nr_pagamento, nr_previsto, 0) ELSE coalesce(nr_realizado, nr_pagamento, nr_previsto, 0) END AS x FROM pagamentos SEMI JOIN lancamentos USING (cd_lancamento)
  UNION ALL SELECT 'lancamentos_sem_pagamento_com_emissao_no_periodo', coalesce(nr_nota_liquido, nr_nota_bruto) AS note FROM lancamentos ANTI JOIN pagamentos USING (cd_lancamento) WHERE dt_emissao {_D} AND note <> 0
  UNION ALL SELECT CASE WHEN nr_valor <> 0 THEN 'transferencias_importaveis_geram_duas_pontas' ELSE 'transferencias_no_periodo_com_valor_zero' END, coalesce(nr_valor, 0) FROM bancos_transfere WHERE {_DAYS} {_D}),
told AS (SELECT unnest(['pagamentos_importaveis', 'pagamentos_no_periodo_com_valor_zero', 'pagamentos_sem_data_realizada_com_vencimento_no_periodo', 'lancamentos_sem_pagamento_com_emissao_no_periodo', 'transferencias_importaveis_geram_duas_pontas', 'transferencias_no_periodo_com_valor_zero']) AS motivo)
SELECT motivo, count(x) AS qtd, sum(x)::DECIMAL(28,2) AS total FROM told LEFT JOIN v USING (motivo) GROUP BY motivo"""


@query(f"{SQL}, {_REASONS}")
def audit_not_imported(spark: SparkSession, sf: str) -> DataFrame:
    return erp.audit_not_imported(tables(spark, sf), FIRST, LAST)


@query(_ALL + f""", k AS (SELECT cd_empresa, count(*) FILTER (WHERE sistema_origem = 'CLINUX') AS pq, sum(valor) FILTER (WHERE sistema_origem = 'CLINUX') AS pt, count(*) FILTER (WHERE sistema_origem <> 'CLINUX') AS tq, sum(valor) FILTER (WHERE sistema_origem <> 'CLINUX') AS tt FROM rows_ WHERE cd_empresa % 4 <> 1 GROUP BY cd_empresa)
SELECT e.cd_empresa, e.ds_empresa, e.ds_razao, e.ds_cnpj, coalesce(pq, 0) AS pagamentos_qtd, coalesce(pt, 0)::DECIMAL(28,2) AS pagamentos_total, coalesce(tq, 0) AS transferencias_qtd, coalesce(tt, 0)::DECIMAL(28,2) AS transferencias_total,
 CASE WHEN coalesce(pq, 0) + coalesce(tq, 0) > 0 THEN '{erp.IMPORTED}' ELSE '{erp.NOT_IMPORTED}' END AS status FROM empresas e LEFT JOIN k ON k.cd_empresa = e.cd_empresa""")  # fmt: skip
def audit_companies(spark: SparkSession, sf: str) -> DataFrame:
    return erp.audit_companies(tables(spark, sf)["empresas"], _ledger(spark, sf).where("cd_empresa % 4 <> 1"))


_STATUS = "CASE id % 3 WHEN 0 THEN 'CANCELADO' WHEN 1 THEN 'ABERTO' END"
_PAYDAY = "CASE WHEN id % 2 = 0 THEN data_ref END"
_KIND = "CASE WHEN id % 5 = 0 THEN 'SALDO' ELSE tipo END"


def _open(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).select("id", F.expr(_KIND).alias("tipo"), "valor", F.expr(_PAYDAY).alias("data_pagamento"), F.col("data_ref").alias("data_lancamento"), F.expr(f"{_STATUS}").alias("status"))


_OPEN = f"{FACTS}, o AS (SELECT id, {_KIND} AS tipo, valor, {_PAYDAY} AS data_pagamento, data_ref AS data_lancamento, {_STATUS} AS status FROM ledger) "


@query(_OPEN + f"SELECT id, tipo, valor, status FROM o WHERE coalesce(data_pagamento, data_lancamento) {_D} AND coalesce(status, '') <> 'CANCELADO' AND tipo IN ('ENTRADA', 'SAIDA')")
def filter_open_window(spark: SparkSession, sf: str) -> DataFrame:
    return erp.open_window(_open(spark, sf), "data_pagamento", "data_lancamento", FIRST, LAST).select("id", "tipo", "valor", "status")


@query(_OPEN + "SELECT id, tipo, valor FROM o WHERE tipo IN ('ENTRADA', 'SAIDA') AND year(data_pagamento) BETWEEN 1996 AND 1998")
def filter_year_window(spark: SparkSession, sf: str) -> DataFrame:
    return erp.year_window(_open(spark, sf), "data_pagamento", 1996, 1998)[0].select("id", "tipo", "valor")


@query(_OPEN + "SELECT count(*) AS fora_periodo FROM o WHERE tipo IN ('ENTRADA', 'SAIDA') AND data_pagamento IS NOT NULL AND year(data_pagamento) NOT BETWEEN 1996 AND 1998")
def filter_out_of_years(spark: SparkSession, sf: str) -> DataFrame:
    return erp.year_window(_open(spark, sf), "data_pagamento", 1996, 1998)[1]


_CELL = "CASE event_id % 6 WHEN 0 THEN ' 2024-02-30' WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN '12.50' WHEN 3 THEN 'a' || chr(13) || 'b ' WHEN 4 THEN '' END"


@query(f"WITH c AS (SELECT event_id, {_CELL} AS x FROM events), t AS (SELECT event_id, trim(replace(coalesce(x, ''), chr(13), ' ')) AS t FROM c) SELECT event_id, CASE WHEN length(t) = 10 THEN try_cast(t AS DATE) END AS dia, nullif(CASE WHEN length(t) = 10 AND try_cast(t AS DATE) IS NOT NULL THEN '' ELSE t END, '') AS texto, try_cast(t AS DECIMAL(38,6)) AS numero FROM t")
def scalar_report_cell(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 6
    x = F.when(k == 0, " 2024-02-30").when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, "12.50").when(k == 3, "a\rb ").when(k == 4, "")
    day, number = values.report_cell("Data", x), values.report_cell("valor", x)
    return read(spark, sf, "events").select("event_id", day["day"].alias("dia"), day["text"].alias("texto"), number["number"].alias("numero"))
