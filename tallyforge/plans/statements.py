"""Queries on bank statements, which are printed from the given orders, with their SQL.

Every layout prints all orders: a file for each customer and year, a header, and for each order its lines in that
layout, with lines that are no rows between them. The SQL tells from the orders what must be read back.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans.fixtures import read
from tallyforge.plans.queries import query
from tallyforge.sources import statements

_TAX = "12.345.678/0001-90"


@dataclass
class Print:
    """Lines of a layout: header of a file, rows of an order; what is read back: description and document (SQL), and of
    the header company, tax id, agency, account and digit (SQL)."""

    name: str
    header: list[str]
    rows: list[str]
    desc: str = "descr"
    doc: str = "''"
    told: tuple[str, str, str, str, str] = ("'EMPRESA ' || cust", f"'{_TAX}'", "NULL", "cust", "NULL")


_FIRST = f"'Titular EMPRESA ' || cust || ' Instituição Stone Documento {_TAX} Agência 0001 Conta ' || cust || '-0 '"
PRINTS = {
    "CORA": Print("cora.pdf", ["EMPRESA {cust}", "CNPJ " + _TAX, "Agência: 0001 - Conta: {cust}-4 CORA"], ["{date} Saldo do dia R$ 10,00", "{descr} {pm} R$ {value}"], told=("'EMPRESA ' || cust", f"'{_TAX}'", "'0001'", "cust", "'4'")),
    "CLINUX_EXTRATO_BANCO": Print("x.pdf", ["EMPRESA {cust}", "EXTRATO BANCO USUARIO", _TAX, "BANCO: CAIXA {cust} - PERIODO: ANO"], ["{date} SALDO INICIAL 1,00", "{date} {descr} {minus}{value}"], told=("'EMPRESA ' || cust", f"'{_TAX}'", "NULL", "NULL", "NULL")),
    "BRADESCO_NET_EMPRESA": Print("bradesco.pdf", ["EMPRESA {cust} | CNPJ: " + _TAX, "0123 | {cust}-5", "Data Lançamento Dcto Saldo"], ["{descr}", "{date} {doc} {minus}{value} 90,00", "DEST: LOJA", "SALDO DO DIA 1,00"], "descr || ' DEST: LOJA'", "doc", ("'EMPRESA ' || cust", f"'{_TAX}'", "'123'", "cust", "'5'")),
    "CAIXA_GERENCIADOR": Print("x.pdf", ["EXTRATO POR PERIODO CAIXA", "Cliente: EMPRESA {cust}", "Conta: 0123 | 003 | {cust}-1"], ["{date} {doc} {descr} {value} {cd} 1.000,00 C", "{date} 000000 SALDO DIA 0,00 C 1.000,00 C"], doc="doc", told=("'EMPRESA ' || cust", "NULL", "'0123'", "cust", "'1'")),
    "BANCO_DO_BRASIL_CONTA_CORRENTE": Print("extrato bb.pdf", ["Agência 1234-5", "Conta corrente {cust}-6 EMPRESA {cust}"], ["{date} 0000 14397 821 {descr} {value} {cd} 10,00 C", "05/03 10:11 JOSE 12345678901"], "descr || ' JOSE 12345678901'", "'12345678901'", ("'EMPRESA ' || cust", "NULL", "'1234-5'", "cust", "'6'")),
    "BASA_AMAZONIA_ONLINE": Print("basa.pdf", ["Nome do Cliente: EMPRESA {cust}", "Agência: 0077", "Conta: {cust}-7", "Movimentações"], ["{date} {doc} {descr} R$ {value} {cd}", "SALDO DO DIA", "CONTINUA"], "descr || ' CONTINUA'", "doc", ("'EMPRESA ' || cust", "NULL", "'0077'", "cust", "'7'")),
    "SICOOB_SISBR": Print("x.pdf", ["SICOOB", "CONTA: {cust}-8 / EMPRESA {cust}", "PERÍODO: 01/01/{year}"], ["{dm} {descr} {value}{cd}", "Fulano", "DOC.: {doc}", "{dm} SALDO DO DIA 1,00C"], "descr || ' Fulano'", "doc", ("'EMPRESA ' || cust", "NULL", "NULL", "cust", "'8'")),
    "SAFRA_EXTRATO_MOVIMENTACAO": Print("safra.pdf", ["BANCO SAFRA Período de 01/01/{year}", "Extrato de Movimentação EMPRESA {cust}", "CNPJ: " + _TAX + " | AG: 0099 | CONTA: {cust}-9", "LANÇAMENTOS REALIZADOS"], ["{dm} {descr} {minus}{value}", "12345678 90"], "descr || ' 12345678 90'", told=("'EMPRESA ' || cust", f"'{_TAX}'", "'0099'", "cust", "'9'")),
    "STONE_CONTA_CORRENTE": Print("stone.pdf", ["Titular EMPRESA {cust}", "Instituição Stone", "Documento " + _TAX + " Agência 0001", "Conta {cust}-0", "Data Tipo Descrição"], ["{descr}", "{date} {kind} {value} 3,00", "FULANO | 12345678901"], f"CASE WHEN row_no = 1 THEN {_FIRST} ELSE '' END || descr || ' FULANO | 12345678901'", f"CASE WHEN row_no = 1 THEN '{_TAX}' ELSE '12345678901' END", ("'EMPRESA ' || cust", f"'{_TAX}'", "'0001'", "cust", "'0'")),
    "BNB_CONTA_CORRENTE": Print("x.pdf", ["Titular: EMPRESA {cust}", "Agência/Conta Corrente: 0123 - X/{cust}-3 Detalhamento do Extrato", "Data Histórico Documento Valor"], ["COMPLEMENTO", "{date} {descr} {doc} {minus}{value} 97,00"], "'COMPLEMENTO ' || descr", "doc", ("'EMPRESA ' || cust", "NULL", "'0123'", "cust", "'3'")),
    "UNICRED_CONTA_CORRENTE": Print("x.pdf", ["UNICRED EXTRATO DE CONTA CORRENTE PARA SIMPLES CONFERENCIA", "CONTA: {cust}", "CLIENTE: EMPRESA {cust}", "USUARIO: X"], ["{date} {doc} {descr} {minus}{value} 9,00"], doc="doc", told=("'EMPRESA ' || cust", "NULL", "NULL", "cust", "NULL")),
    "UNICRED_CONTA_CORRENTE_NOVO": Print("unicred.pdf", ["Coop: 1 - AG: 0012 - Conta: {cust}", "Extrato EMPRESA {cust}", "Período {year}", "Data Lançamentos Valor"], ["{descr} (Doc.: {doc})", "{date} {gap}R$ {value} R$ 9,00"], "descr || ' (Doc.: ' || doc || ')'", "doc", ("'EMPRESA ' || cust", "NULL", "'0012'", "cust", "NULL")),
    "UNIPRIME_CONTA_CORRENTE": Print("uniprime.pdf", ["Cooperativa Uniprime CONTA CORRENTE", "Conta Corrente: {cust}-2", "Agência: 0003", "Cooperado: EMPRESA {cust} Usuário: Y"], ["{date} {doc} {descr} {value} {pm} 88,00"], doc="doc", told=("'EMPRESA ' || cust", "NULL", "'0003'", "cust", "'2'")),
    "ITAU_CONTA_CORRENTE": Print("itau.pdf", ["ITAU lançamentos do período: 01/01/{year}", "EMPRESA {cust} agência conta corrente " + _TAX + " 0456 {cust}-1", "data lançamentos valor (R$) saldo (R$)"], ["{dmes} {descr} {minus}{value}", "{date} SALDO DO DIA 1,00"], told=("'EMPRESA ' || cust", f"'{_TAX}'", "'0456'", "cust", "'1'")),
    "CAIXA_EXTRATO_NOVO": Print("caixa.pdf", ["EMPRESA {cust}", "Extrato no período", "CNPJ: " + _TAX, "Agência: 0123 Conta: {cust}-4", "Data Documento Histórico Valor"], ["{descr}", "{date}{dash}", "{doc} JOSE R$ 110,00 C", "05/03 10:22:01", "R$ {value}", "SALDO DIA R$ 1,00 C"], "descr || ' JOSE'", "doc", ("'EMPRESA ' || cust", f"'{_TAX}'", "'123'", "cust", "'4'")),
}

_BASE = """WITH o AS (
  SELECT o_custkey::VARCHAR AS cust, year(o_orderdate::DATE) AS ano, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'F' THEN 'ENTRADA' ELSE 'SAIDA' END AS tipo, o_totalprice::DECIMAL(18,2) AS valor,
    'PIX ' || o_orderpriority AS descr, lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS doc, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate::DATE) ORDER BY o_orderkey)::INTEGER AS row_no FROM orders)
"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """The parts that a template may name, one row an order."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"), "o_orderpriority").withColumn("year", F.year("d").cast("string"))
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey", "year")
    paid = F.col("o_orderstatus") != "F"
    either = lambda a, b: F.when(paid, a).otherwise(b)
    months = F.array(*(F.lit(m) for m in statements.MONTHS))
    return o.select(
        F.col("o_custkey").cast("string").alias("cust"), "year", F.row_number().over(Window.partitionBy("o_custkey", "year").orderBy("o_orderkey")).alias("row_no"), F.date_format("d", "dd/MM/yyyy").alias("date"), F.date_format("d", "dd/MM").alias("dm"),
        F.concat(F.date_format("d", "dd"), F.lit(" / "), F.element_at(months, F.month("d"))).alias("dmes"), F.translate(F.format_number("v", 2), ",.", ".,").alias("value"), F.concat(F.lit("PIX "), "o_orderpriority").alias("descr"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0").alias("doc"), either("-", "+").alias("pm"), either("-", "").alias("minus"), either("- ", "").alias("gap"), either(" -", "").alias("dash"), either("D", "C").alias("cd"), either("Débito", "Crédito").alias("kind"),
    )


def _filled(template: str) -> Column:
    parts = [F.col(x) if is_name else F.lit(x) for before, name, *_ in string.Formatter().parse(template) for x, is_name in ((before, False), (name, True)) if x]
    return F.concat(*parts)


def lines(spark: SparkSession, sf: str, layout: str) -> DataFrame:
    """The line table of all statements of a layout; the header is page 1."""
    p, o = PRINTS[layout], _orders(spark, sf)
    rows = o.select("*", F.posexplode(F.array(*map(_filled, p.rows))).alias("at", "line"))
    head = o.where("row_no = 1").select("*", F.posexplode(F.array(*map(_filled, p.header))).alias("at", "line"))
    out = rows.withColumn("page", F.lit(2)).withColumn("line_no", F.col("row_no") * len(p.rows) + F.col("at")).unionByName(head.withColumn("page", F.lit(1)).withColumn("line_no", F.col("at")))
    return out.select(F.concat_ws("/", F.lit(layout), "cust", "year", F.lit(p.name)).alias("file"), "page", "line_no", "line")


def _file(layout: str) -> str:
    return f"'{layout}/' || cust || '/' || ano || '/{PRINTS[layout].name}'"


def _row_query(layout: str) -> None:
    p = PRINTS[layout]

    def f(spark: SparkSession, sf: str) -> DataFrame:
        return statements.parse(lines(spark, sf, layout))

    f.__name__ = f"statement_{layout.lower()}"
    query(f"{_BASE} SELECT {_file(layout)} AS file, '{layout}' AS layout, 2 AS page, row_no, strftime(d, '%d/%m/%Y') AS data, tipo, valor, {p.desc} AS descricao, {p.doc} AS documento FROM o")(f)


for _layout in PRINTS:
    _row_query(_layout)


def _header_sql(layout: str) -> str:
    bank, code = statements.BANKS.get(layout, (None, None))
    name, tax, agency, account, digit = PRINTS[layout].told
    quoted = lambda s: f"'{s}'" if s else "NULL"
    own = "'CAIXA ' || cust" if layout == "CLINUX_EXTRATO_BANCO" else quoted(bank)
    warning = quoted(statements.ERP_WARNING) if layout == "CLINUX_EXTRATO_BANCO" else "NULL"
    return f"SELECT {_file(layout)} AS file, '{layout}' AS layout, {own} AS banco_nome, {quoted(code)} AS banco_codigo, {name} AS empresa_nome, {tax} AS empresa_cnpj, {agency} AS agencia, {account} AS conta, {digit} AS digito, {warning} AS aviso FROM o WHERE row_no = 1"


@query(_BASE + " UNION ALL ".join(map(_header_sql, PRINTS)))
def statement_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Bank, company and account of every file of every layout."""
    first, *rest = (lines(spark, sf, layout) for layout in PRINTS)
    for x in rest:
        first = first.unionByName(x)
    return statements.headers(first)
