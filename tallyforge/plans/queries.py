"""Every query with its SQL for comparison, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import fixed, text, values
from tallyforge.operators import candidates, etl, reports, resolve, scoring
from tallyforge.operators.features import bank_features, ledger_features
from tallyforge.plans.fixtures import SQL, bank, ledger, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_MONEY = "DECIMAL(18,2)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def norm_sql(c: str) -> str:
    """`normalize` in DuckDB for characters that fold one to one."""
    return f"trim(regexp_replace(lower(regexp_replace(translate(coalesce({c}, ''), '{_quoted(text.FOLD_FROM)}', '{_quoted(text.FOLD_TO)}'), '\\p{{M}}', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def digits_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"


def root_sql(c: str) -> str:
    return f"CASE WHEN length({digits_sql(c)}) = 14 THEN left({digits_sql(c)}, 8) ELSE {digits_sql(c)} END"


def tokens_sql(n: str) -> str:
    ignored = ", ".join(f"'{t}'" for t in fixed.IGNORED_TOKENS)
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{ignored}], w)))"


def tax_sql(n: str) -> str:
    one = ", ".join(f"'{t}'" for t in fixed.TAX_TERMS if " " not in t)
    more = " OR ".join(f"contains({n}, '{t}')" for t in fixed.TAX_TERMS if " " in t)
    return f"({n} <> '' AND (list_has_any(string_split({n}, ' '), [{one}]) OR {more}))"


def federal_sql(n: str) -> str:
    return f"(contains({n}, 'caixa economica') OR (list_contains(string_split({n}, ' '), 'caixa') AND contains({n}, 'economic')))"


FEATURES = SQL + f""",
b0 AS (SELECT *, {norm_sql("descricao")} AS norm FROM bank),
b AS (SELECT *, (valor * 100)::BIGINT AS cents, strftime(data_ref, '%Y-%m') AS month, {digits_sql("documento")} AS doc, {root_sql("documento")} AS root, {tokens_sql("norm")} AS toks, {federal_sql("norm")} AS federal FROM b0),
l0 AS (SELECT *, {norm_sql("concat_ws(' ', nullif(favorecido, ''), nullif(descricao, ''))")} AS norm, {norm_sql("favorecido")} AS payee FROM ledger),
l AS (SELECT *, (valor * 100)::BIGINT AS cents, strftime(data_ref, '%Y-%m') AS month, {digits_sql("documento")} AS doc, {root_sql("documento")} AS root, {tokens_sql("norm")} AS toks, {tax_sql("norm")} AS tax FROM l0)
"""

# --- scalar functions


@query(f"SELECT doc_id, {digits_sql('text')} AS digits, {root_sql('text')} AS root FROM documents")
def scalar_digits_and_root(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", text.digits("text").alias("digits"), text.doc_root("text").alias("root"))


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def scalar_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", text.normalize("text").alias("norm"))


@query(f"SELECT doc_id, array_to_string(list_sort({tokens_sql(norm_sql('text'))}), ' ') AS toks FROM documents")
def scalar_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.tokens(text.normalize("text"))), " ").alias("toks"))


_WORDS = "list_extract(['toner e papel', 'darf imposto', 'frete combustivel', 'exame clinica', 'caixa econômica federal', 'outros itens'], (p_partkey % 6 + 1)::BIGINT)"


@query(f"SELECT p_partkey, {federal_sql(norm_sql(_WORDS))} AS federal, {tax_sql(norm_sql(_WORDS))} AS tax, " + " || ',' || ".join(f"CASE WHEN list_has_any({tokens_sql(norm_sql(_WORDS))}, [{', '.join(chr(39) + w + chr(39) for w in ws)}]) THEN '{k}' ELSE '' END" for k, ws in sorted(fixed.CATEGORIES.items())) + " AS cats FROM part")
def scalar_categories_and_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("toner e papel", "darf imposto", "frete combustivel", "exame clinica", "caixa econômica federal", "outros itens"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    df = read(spark, sf, "part").select("p_partkey", text.normalize(words).alias("n"))
    cats = text.categories(text.tokens("n"))
    return df.select("p_partkey", text.is_federal_bank("n").alias("federal"), text.is_tax("n").alias("tax"), F.concat_ws(",", *(F.when(F.array_contains(cats, k), k).otherwise("") for k in sorted(fixed.CATEGORIES))).alias("cats"))


_V = "o_totalprice::DECIMAL(18,2)"


@query(f"""SELECT o_orderkey, {_V} AS statement, (floor({_V}) + 0)::{_MONEY} AS ledger, {_V} AS ofx, ({_V} * 100)::BIGINT AS cents,
 'R$ ' || translate(format('{{:,}}', floor({_V})::BIGINT) || '.' || lpad((({_V} * 100)::BIGINT % 100)::VARCHAR, 2, '0'), ',.', '.,') AS brl FROM orders""")
def scalar_money(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("o_totalprice").cast(values.MONEY)
    pt = F.translate(F.format_number(v, 2), ",.", ".,")
    return read(spark, sf, "orders").select("o_orderkey", values.money_statement(F.concat(F.lit("R$ "), pt)).alias("statement"), values.money_ledger(F.floor(v).cast("string")).alias("ledger"), values.money_ofx(F.concat(F.lit("-"), F.replace(v.cast("string"), F.lit("."), F.lit(",")))).alias("ofx"), values.cents(v).alias("cents"), values.brl(v).alias("brl"))


@query("SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS br, o_orderdate::DATE AS dash, o_orderdate::DATE AS ofx, NULL::DATE AS bad FROM orders")
def scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    f = lambda p: F.date_format(d, p)
    return read(spark, sf, "orders").select("o_orderkey", values.date_any(f("yyyy-MM-dd")).alias("iso"), values.date_any(f("dd/MM/yyyy")).alias("br"), values.date_any(f("dd-MM-yyyy")).alias("dash"), values.date_ofx(F.concat(f("yyyyMMdd"), F.lit("120000"))).alias("ofx"), values.date_any(F.lit("31/13/2020")).alias("bad"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus IN ('F', 'U') THEN 'ENTRADA' ELSE 'SAIDA' END WHEN o_orderkey % 3 = 1 THEN 'SAIDA' ELSE 'ENTRADA' END AS erp,
 CASE o_orderkey % 3 WHEN 0 THEN 'ENTRADA' WHEN 1 THEN 'SAIDA' END AS ofx, CASE o_orderkey % 3 WHEN 0 THEN 'ENTRADA' WHEN 1 THEN 'SAIDA' END AS csv FROM orders""")
def scalar_movement_kinds(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("o_orderkey") % 3
    flag = F.when(r == 1, True).when(r == 2, False)
    return read(spark, sf, "orders").select("o_orderkey", values.kind_erp(flag, "o_orderstatus").alias("erp"), values.kind_ofx(F.when(r == 0, "credit").when(r == 1, "DEBIT").otherwise("XFER")).alias("ofx"), values.kind_ledger(F.when(r == 0, " receita").when(r == 1, "Despesa").otherwise("?")).alias("csv"))


@query(r"SELECT doc_id, regexp_extract(coalesce(text, ''), '(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|\b\d{11,14}\b)', 1) AS documento FROM documents")
def scalar_extract_document(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", values.document_in("text").alias("documento"))


@query("""SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS conta, (c_custkey % 10)::VARCHAR AS digito, 'SEM-CNPJ:' || left(sha1(c_name || '|' || c_mktsegment), 11) AS chave,
 '00.' || substr(lpad(c_custkey::VARCHAR, 12, '0'), 1, 3) || '.' || substr(lpad(c_custkey::VARCHAR, 12, '0'), 4, 3) || '/' || substr(lpad(c_custkey::VARCHAR, 12, '0'), 7, 4) || '-' || substr(lpad(c_custkey::VARCHAR, 12, '0'), 11, 2) AS cnpj FROM customer""")
def scalar_account_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    conta, digito = values.account_parts(F.concat(F.substring(k, 1, 3), F.lit("."), F.substring(k, 4, 3), F.lit("-"), (F.col("c_custkey") % 10).cast("string")))
    return read(spark, sf, "customer").select("c_custkey", conta.alias("conta"), digito.alias("digito"), values.surrogate_company("c_name", "c_mktsegment").alias("chave"), values.company_number(F.lpad(F.col("c_custkey").cast("string"), 14, "0")).alias("cnpj"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SALDO_ANTERIOR' WHEN 1 THEN 'SALDO_DIA' ELSE 'MOVIMENTACAO' END AS registro, CASE event_id % 4 WHEN 0 THEN 2021 WHEN 1 THEN 2023 WHEN 2 THEN NULL ELSE 2020 END::INTEGER AS ano,
 CASE WHEN event_id % 5 = 0 THEN 'ERRO_LEITURA' WHEN event_id % 5 = 1 THEN 'IMPORTAVEL' WHEN event_id % 5 = 2 THEN 'PRECISA_OCR' WHEN event_id % 5 = 3 THEN 'NAO_SUPORTADO' ELSE 'SEM_MOVIMENTO_CONCILIAVEL' END AS estado, event_id % 5 = 0 AS rede FROM events""")
def scalar_file_states(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("event_id") % n + 1).cast("int"))
    err = F.when(F.col("event_id") % 5 == 0, "Network path gone")
    state = values.extraction_status(pick(5, "", "CORA", "PDF_SEM_TEXTO_EXTRAIVEL", "NAO_SUPORTADO", "UNICRED_RENTABILIDADE"), pick(5, 0, 3, 0, 0, 0), err)
    return e.select("event_id", values.record_kind(pick(3, "saldo anterior", "SALDO TOTAL DISPONIVEL DIA", "pix")).alias("registro"), values.year_in_path(pick(4, "/x/2021/a2019.pdf", "c:/a_2023.pdf", "/none", "/2020/2021/z")).alias("ano"), state.alias("estado"), values.network_error(state, err).alias("rede"))


# --- filters and joins


@query(SQL + "SELECT id, data_ref, tipo, valor FROM bank WHERE data_ref BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND tipo = 'SAIDA' AND empresa_id IN (1, 2, 3)")
def filter_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    conds = [F.col("data_ref").between("1995-01-01", "1995-12-31"), F.col("tipo") == "SAIDA", F.col("empresa_id").isin(1, 2, 3)]
    df = bank(spark, sf)
    for c in conds:
        df = df.where(c)
    return df.select("id", "data_ref", "tipo", "valor")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_enriched(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    # Nations and regions are fixed, tiny dimensions.
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS valor FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_not_linked_anti(spark: SparkSession, sf: str) -> DataFrame:
    linked = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").join(linked, "o_orderkey", "left_anti").select("o_orderkey", F.col("o_totalprice").cast(values.MONEY).alias("valor"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1993-01-01') OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def join_retention_semi(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    a = o.join(read(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz'1993-01-01'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    b = o.join(read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return a.select("o_orderkey").union(b.select("o_orderkey")).distinct()


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 49)")
def join_orphans_anti(spark: SparkSession, sf: str) -> DataFrame:
    used = read(spark, sf, "lineitem").where("l_discount >= 0.1 and l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf, "supplier").join(used, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


_TRANSFERS = "SELECT o_orderkey AS id, o_orderdate::DATE AS data_ref, o_totalprice::DECIMAL(18,2) AS nr_valor, 'N' || (o_custkey % 25) AS src, 'N' || (o_orderkey % 25) AS dst FROM orders WHERE o_orderkey % 7 = 0"


def _transfers(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where("o_orderkey % 7 = 0")
    return o.select(F.col("o_orderkey").alias("cd_transferencia"), F.col("o_orderdate").cast("date").alias("data_ref"), F.col("o_totalprice").cast(values.MONEY).alias("nr_valor"), F.expr("concat('N', o_custkey % 25)").alias("banco_origem"), F.expr("concat('N', o_orderkey % 25)").alias("banco_destino"))


@query(f"WITH t AS ({_TRANSFERS}) SELECT 'CLINUX:TRANSFERENCIA:' || id || ':SAIDA_ORIGEM' AS identificador_externo, data_ref, 'SAIDA' AS tipo, src AS banco, nr_valor AS valor, id::VARCHAR AS documento FROM t UNION ALL SELECT 'CLINUX:TRANSFERENCIA:' || id || ':ENTRADA_DESTINO', data_ref, 'ENTRADA', dst, nr_valor, id::VARCHAR FROM t")
def join_transfer_two_sides(spark: SparkSession, sf: str) -> DataFrame:
    return etl.ledger_from_transfers(_transfers(spark, sf))


@query(f"WITH t AS ({_TRANSFERS}), u AS (SELECT src AS banco, -nr_valor AS v FROM t UNION ALL SELECT dst, nr_valor FROM t) SELECT banco, count(*) AS qtd, sum(v)::DECIMAL(28,2) AS saldo FROM u GROUP BY banco")
def agg_transfers_by_company(spark: SparkSession, sf: str) -> DataFrame:
    signed = F.when(F.col("tipo") == "SAIDA", -F.col("valor")).otherwise(F.col("valor"))
    return etl.ledger_from_transfers(_transfers(spark, sf)).groupBy("banco").agg(F.count("*").alias("qtd"), F.sum(signed).alias("saldo"))


_PAIR = "b.id AS bank_id, l.id AS ledger_id"


@query(FEATURES + f"SELECT {_PAIR} FROM b JOIN l ON b.tipo = l.tipo AND b.cents = l.cents AND b.doc = l.doc AND b.doc <> ''")
def join_candidate_equal(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.equal_value_and_document(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf))).select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"))


@query(FEATURES + f"SELECT {_PAIR} FROM b JOIN l ON b.tipo = l.tipo AND b.root = l.root AND abs(b.data_ref - l.data_ref) <= 45 AND b.root <> ''")
def join_candidate_band(spark: SparkSession, sf: str) -> DataFrame:
    b, l = bank_features(bank(spark, sf)).where("root <> ''"), ledger_features(ledger(spark, sf)).where("root <> ''")
    return candidates.band(b, l, ["tipo", "root"], fixed.SUPPLIER_DAYS).select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"))


@query(FEATURES + f"SELECT {_PAIR}, (b.valor - l.valor)::DECIMAL(19,2) AS diferenca FROM b JOIN l ON b.tipo = l.tipo AND b.root = l.root AND abs(b.data_ref - l.data_ref) <= 3 AND b.root <> '' AND b.valor <> l.valor")
def join_near_match_band(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.near_match_band(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf))).select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"), (F.col("b_valor") - F.col("l_valor")).alias("diferenca"))


@query(FEATURES + f"SELECT {_PAIR} FROM b JOIN l ON b.tipo = l.tipo AND b.federal AND l.tax AND b.month = l.month AND b.cents = l.cents")
def join_tax_rule(spark: SparkSession, sf: str) -> DataFrame:
    b, l = bank_features(bank(spark, sf)).where("federal"), ledger_features(ledger(spark, sf)).where("tax")
    return candidates.equal_value(b, l, month=True).select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"))


# --- aggregations and reports

_L = "SELECT l_orderkey AS id, l_shipdate::DATE AS data_ref, CASE WHEN l_returnflag = 'R' THEN 'SAIDA' ELSE 'ENTRADA' END AS tipo, l_extendedprice::DECIMAL(18,2) AS valor, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS origem, l_suppkey AS conta, l_linestatus AS grupo, l_quantity, l_partkey FROM lineitem"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("date").alias("data_ref"), F.when(F.col("l_returnflag") == "R", "SAIDA").otherwise("ENTRADA").alias("tipo"), F.col("l_extendedprice").cast(values.MONEY).alias("valor"), F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("origem"), F.col("l_suppkey").alias("conta"), F.col("l_linestatus").alias("grupo"), "l_quantity", "l_partkey")


@query(f"WITH f AS ({_L}) SELECT coalesce(origem, 'SEM_ORIGEM') AS origem, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS total, min(data_ref) AS primeira, max(data_ref) AS ultima FROM f GROUP BY 1")
def agg_base_overview(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_origin(_facts(spark, sf), "origem")


@query(f"WITH f AS ({_L}) SELECT count(*) AS qtd, sum(valor) FILTER (WHERE tipo = 'ENTRADA')::DECIMAL(28,2) AS entradas, sum(valor) FILTER (WHERE tipo = 'SAIDA')::DECIMAL(28,2) AS saidas, min(data_ref) AS primeira, max(data_ref) AS ultima FROM f")
def agg_conditional_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conditional_totals(_facts(spark, sf))


@query(f"WITH f AS ({_L}) SELECT conta, count(*) FILTER (WHERE tipo = 'ENTRADA') AS qtd_entradas, count(*) FILTER (WHERE tipo = 'SAIDA') AS qtd_saidas, coalesce(sum(valor) FILTER (WHERE tipo = 'ENTRADA'), 0)::DECIMAL(28,2) AS entradas, coalesce(sum(valor) FILTER (WHERE tipo = 'SAIDA'), 0)::DECIMAL(28,2) AS saidas, sum(CASE WHEN tipo = 'ENTRADA' THEN valor ELSE -valor END)::DECIMAL(28,2) AS saldo FROM f GROUP BY conta")
def agg_unit_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_unit(_facts(spark, sf), "conta")


@query(f"WITH f AS ({_L}) SELECT date_trunc('year', data_ref)::DATE AS periodo, tipo, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS total FROM f GROUP BY 1, 2")
def agg_year_and_kind(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_period_and_kind(_facts(spark, sf), "year")


@query(f"WITH f AS ({_L}) SELECT date_trunc('month', data_ref)::DATE AS periodo, tipo, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS total FROM f GROUP BY 1, 2")
def agg_month_and_kind(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_period_and_kind(_facts(spark, sf), "month")


@query(f"WITH f AS ({_L}) SELECT origem, tipo, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS total FROM f GROUP BY ALL")
def agg_origin_and_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).groupBy("origem", "tipo").agg(F.count("*").alias("qtd"), F.sum("valor").alias("total"))


@query(f"WITH f AS ({_L}) SELECT tipo, count(*) AS qtd, sum(valor)::DECIMAL(28,2) AS total, min(valor) AS menor, max(valor) AS maior, count(*) FILTER (WHERE valor < 2000) AS pequenos FROM f GROUP BY tipo")
def agg_type_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).groupBy("tipo").agg(F.count("*").alias("qtd"), F.sum("valor").alias("total"), F.min("valor").alias("menor"), F.max("valor").alias("maior"), F.count_if(F.col("valor") < 2000).alias("pequenos"))


@query(f"WITH f AS ({_L}) SELECT grupo, conta, tipo, sum(valor)::DECIMAL(28,2) AS total FROM f GROUP BY ALL ORDER BY total DESC NULLS LAST, grupo, conta, tipo LIMIT 120")
def agg_top_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).groupBy("grupo", "conta", "tipo").agg(F.sum("valor").alias("total")).orderBy(F.desc_nulls_last("total"), "grupo", "conta", "tipo").limit(120)


@query(f"WITH f AS ({_L}) " + " UNION ALL ".join(f"SELECT '{n}' AS motivo, count(*) AS qtd, coalesce(sum(valor), 0)::DECIMAL(28,2) AS total FROM f WHERE {c}" for n, c in (("importavel", "l_quantity > 10"), ("pequeno", "l_quantity <= 10"), ("sem_origem", "origem IS NULL"), ("zero", "valor = 0"))))
def agg_quality_buckets(spark: SparkSession, sf: str) -> DataFrame:
    # One scan: a row falls into every bucket whose condition holds.
    checks = {"importavel": "l_quantity > 10", "pequeno": "l_quantity <= 10", "sem_origem": "origem is null", "zero": "valor = 0"}
    one = _facts(spark, sf).agg(*(x for n, c in checks.items() for x in (F.count_if(F.expr(c)).alias(f"{n}_n"), F.coalesce(F.sum(F.when(F.expr(c), F.col("valor"))), F.lit(0).cast("decimal(28,2)")).alias(f"{n}_t"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("motivo"), F.col(f"{n}_n").alias("qtd"), F.col(f"{n}_t").alias("total")) for n in checks))).alias("x")).select("x.*")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS qtd, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2) AS total FROM lineitem GROUP BY ALL")
def agg_type_flags(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("qtd"), F.sum(F.col("l_extendedprice").cast(values.MONEY)).alias("total"))


@query(FEATURES + ", u AS (SELECT doc, tipo, cents, month AS mes, 1 AS nb, 0 AS nl FROM b UNION ALL SELECT doc, tipo, cents, month, 0, 1 FROM l) SELECT doc, tipo, cents, mes, sum(nb)::BIGINT AS qtd_banco, sum(nl)::BIGINT AS qtd_sistema FROM u WHERE doc <> '' GROUP BY ALL")
def agg_repetitions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.repetitions(bank(spark, sf), ledger(spark, sf))


@query(FEATURES + """, u AS (SELECT 'BANCO' AS origem, month AS periodo, tipo, cents, CASE WHEN root <> '' THEN root ELSE array_to_string(string_split(norm, ' ')[1:6], ' ') END AS chave, id, data_ref FROM b
 UNION ALL SELECT 'SISTEMA', month, tipo, cents, CASE WHEN root <> '' THEN root ELSE array_to_string(string_split(norm, ' ')[1:6], ' ') END, id, data_ref FROM l)
SELECT origem, periodo, tipo, (cents * 0.01)::DECIMAL(18,2) AS valor, count(*) AS quantidade, string_agg(id::VARCHAR, ', ' ORDER BY data_ref, id) AS ids, chave, 'Possivel duplicidade: mesmo mes, tipo, valor e documento/texto-base.' AS observacao FROM u GROUP BY origem, periodo, tipo, cents, chave HAVING count(*) >= 2""")
def agg_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reports.duplicates(bank(spark, sf), ledger(spark, sf))


@query("SELECT max(event_id) AS marca, count(*) AS qtd FROM events WHERE event_id % 3 <> 0")
def agg_high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CLINUX:PAGAMENTO:x"), F.col("event_id"))).otherwise(F.concat(F.lit("CLINUX:PAGAMENTO:"), F.col("event_id").cast("string")))
    return read(spark, sf, "events").agg(etl.high_water_mark(ids, etl.PAYMENT_ID).alias("marca"), F.count_if(F.col("event_id") % 3 != 0).alias("qtd"))


@query("SELECT event_type, min(ts)::DATE AS inicio, max(ts)::DATE AS fim FROM events GROUP BY event_type")
def agg_period_bounds(spark: SparkSession, sf: str) -> DataFrame:
    mixed = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return read(spark, sf, "events").withColumn("d", values.date_any(mixed)).groupBy("event_type").agg(F.min("d").alias("inicio"), F.max("d").alias("fim"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT event_id % 10 AS empresa, count(*) AS qtd, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS soma FROM events GROUP BY 1")
def agg_json_property(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy((F.col("event_id") % 10).alias("empresa")).agg(F.count("*").alias("qtd"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("soma"))


# --- scores

_SAME, _NEAR, _D = "(b.doc <> '' AND b.doc = l.doc)", "abs(b.data_ref - l.data_ref) <= 3", "abs(b.data_ref - l.data_ref)"
_CLOSE = f"({_SAME} OR (length(b.doc) = 14 AND length(l.doc) = 14 AND b.root = l.root))"
_CATS = " OR ".join(f"(list_has_any(b.toks, [{w}]) AND list_has_any(l.toks, [{w}]))" for w in (", ".join(f"'{x}'" for x in ws) for ws in fixed.CATEGORIES.values()))


def _score_sql(by_account: bool) -> str:
    doc = _SAME if by_account else _CLOSE
    late = f"CASE WHEN {_D} <= 45 THEN 'VALOR_TRIBUTO_CAIXA_MES' ELSE 'VALOR_TRIBUTO_CAIXA_DATA_DIFERENTE' END" if by_account else "'VALOR_TRIBUTO_CAIXA_MES'"
    points = " ".join(f"WHEN '{m}' THEN {s}" for m, s in scoring.RULES.items())
    return FEATURES + f""",
p AS (SELECT {_PAIR}, list_has_any(b.toks, l.toks) AS t, CASE WHEN b.cents <> l.cents THEN CASE WHEN {doc} AND {_NEAR} THEN 'CNPJ_DATA_VALOR_DIFERENTE' ELSE 'SEM_CORRESPONDENCIA' END
  WHEN {_SAME} AND {_D} = 0 THEN 'CNPJ_VALOR_DATA' WHEN {_SAME} AND {_NEAR} THEN 'CNPJ_VALOR_DATA_APROXIMADA' WHEN {doc} AND t THEN 'CNPJ_VALOR_FORNECEDOR_DATA_DIFERENTE' WHEN {doc} THEN 'CNPJ_VALOR_DATA_DIFERENTE'
  WHEN b.federal AND l.tax AND {_NEAR} THEN 'VALOR_TRIBUTO_CAIXA_DATA' WHEN b.federal AND l.tax THEN {late}
  WHEN t AND {_D} = 0 THEN 'VALOR_DATA_TEXTO' WHEN t AND {_NEAR} THEN 'VALOR_DATA_TEXTO_APROXIMADA' WHEN t THEN 'VALOR_FORNECEDOR_DATA_DIFERENTE' WHEN {_D} = 0 THEN 'VALOR_DATA' WHEN {_NEAR} THEN 'VALOR_DATA_APROXIMADA'
  WHEN {_CATS} THEN 'VALOR_IGUAL_PALAVRAS_RELACIONADAS_INFO_DIFERENTE' ELSE 'VALOR_IGUAL_INFO_DIFERENTE' END AS metodo
  FROM b JOIN l ON b.tipo = l.tipo AND (b.cents = l.cents OR (b.doc = l.doc AND b.doc <> '' AND {_NEAR}))),
s AS (SELECT bank_id, ledger_id, metodo, CASE metodo {points} END AS score FROM p)
SELECT bank_id, ledger_id, metodo, score, CASE WHEN metodo = 'CNPJ_DATA_VALOR_DIFERENTE' THEN 'DIVERGENCIA' WHEN score >= 95 THEN 'CONCILIADO' WHEN score >= 70 AND (metodo LIKE 'VALOR\\_%' ESCAPE '\\' OR metodo = 'CNPJ_VALOR_DATA_DIFERENTE') THEN 'CONCILIADO_VALOR_IGUAL' WHEN score >= 80 THEN 'POSSIVEL_CORRESPONDENCIA' WHEN score >= 70 THEN 'POSSIVEL_REVISAO' ELSE 'NAO_ENCONTRADO' END AS status FROM s"""


def _pairs(spark: SparkSession, sf: str, by_root: bool = False) -> DataFrame:
    return candidates.scoring_pairs(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf)), by_root)




def _scored(df: DataFrame) -> DataFrame:
    return df.select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"), "metodo", "score", "status")


@query(_score_sql(True))
def score_account_no_text(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(scoring.score_account(_pairs(spark, sf), False))


@query(_score_sql(False))
def score_month_no_text(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(scoring.score_month(_pairs(spark, sf), False))


@query()
def score_account_full(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(scoring.score_account(_pairs(spark, sf)))


@query()
def score_month_full(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the month dialect with a score, among them other values of one company's branches."""
    return _scored(scoring.score_month(_pairs(spark, sf, True)))


@query()
def score_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = candidates.equal_value_and_document(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf)))
    return p.select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"), text.similarity("b_norm", "l_norm").alias("similaridade"))


@query(_score_sql(False).replace("SELECT bank_id, ledger_id, metodo, score, CASE WHEN metodo = 'CNPJ_D", ", r AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY score DESC, ledger_id) AS n FROM s) SELECT bank_id, ledger_id, metodo, score, CASE WHEN metodo = 'CNPJ_D").replace("AS status FROM s", "AS status FROM r WHERE n = 1"))
def score_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(scoring.score_month(_pairs(spark, sf), False))
    n = F.row_number().over(Window.partitionBy("bank_id").orderBy(F.desc("score"), "ledger_id"))
    return s.withColumn("n", n).where("n = 1").drop("n")


@query(FEATURES + """, p AS (SELECT b.id AS bank_id, l.id AS ledger_id, abs(b.data_ref - l.data_ref) AS d FROM b JOIN l ON b.tipo = l.tipo AND b.cents = l.cents AND b.doc = l.doc AND b.doc <> ''),
q AS (SELECT *, CASE WHEN d = 0 THEN 'CONCILIADO' WHEN d <= 3 THEN 'CONCILIADO' ELSE 'CONCILIADO_VALOR_IGUAL' END AS status FROM p)
SELECT status, count(*) AS pares, count(DISTINCT bank_id) AS bancos FROM q GROUP BY status""")
def flagship_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Exact candidates by document, kind and value, classified by distance in days."""
    p = candidates.equal_value_and_document(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf)))
    status = F.when(candidates.days() <= fixed.NEAR_DAYS, "CONCILIADO").otherwise("CONCILIADO_VALOR_IGUAL")
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("pares"), F.countDistinct("b_id").alias("bancos"))


# --- resolvers

_WISH = "-score, d, NOT same, NOT t, ledger_id"
_STATUS = "CASE WHEN metodo = 'CNPJ_DATA_VALOR_DIFERENTE' THEN 'DIVERGENCIA' WHEN score >= 95 THEN 'CONCILIADO' WHEN score >= 70 AND (metodo LIKE 'VALOR\\_%' ESCAPE '\\' OR metodo = 'CNPJ_VALOR_DATA_DIFERENTE') THEN 'CONCILIADO_VALOR_IGUAL' WHEN score >= 80 THEN 'POSSIVEL_CORRESPONDENCIA' WHEN score >= 70 THEN 'POSSIVEL_REVISAO' ELSE 'NAO_ENCONTRADO' END"


def _first_come_sql(name: str, pairs: str) -> str:
    """CTEs up to `name` (bank_id, ledger_id): the loop over the banks of each group, one bank of each group a step.
    pairs: grp, bank_id, ledger_id, turn (sorts banks), wish (rank of the ledger row for its bank, from 1)."""
    return f"""
{name}_p AS ({pairs}),
{name}_t AS (SELECT grp, bank_id, row_number() OVER (PARTITION BY grp ORDER BY any_value(turn)) AS k FROM {name}_p GROUP BY grp, bank_id),
{name}_r AS (
  SELECT DISTINCT grp, 0::BIGINT AS k, NULL::BIGINT AS bank_id, NULL::BIGINT AS ledger_id, []::BIGINT[] AS used FROM {name}_p
  UNION ALL
  SELECT r.grp, r.k + 1, any_value(t.bank_id), arg_min(p.ledger_id, p.wish), CASE WHEN count(p.ledger_id) = 0 THEN any_value(r.used) ELSE list_append(any_value(r.used), arg_min(p.ledger_id, p.wish)) END
  FROM {name}_r r JOIN {name}_t t ON t.grp = r.grp AND t.k = r.k + 1 LEFT JOIN {name}_p p ON p.bank_id = t.bank_id AND NOT list_contains(r.used, p.ledger_id) GROUP BY r.grp, r.k),
{name} AS (SELECT bank_id, ledger_id FROM {name}_r WHERE ledger_id IS NOT NULL)"""


def _scored_sql(by_account: bool) -> str:
    """CTEs up to s: scored pairs without text similarity, with what orders them."""
    return "WITH RECURSIVE" + _score_sql(by_account).split("WITH", 1)[1].split("SELECT bank_id, ledger_id, metodo, score, CASE")[0] + f""",
x AS (SELECT s.*, b.empresa_id, l.empresa_id AS l_empresa_id, b.month, b.tipo, b.cents, l.cents AS l_cents, b.month = l.month AS in_month, b.data_ref, l.data_ref AS l_data_ref, {_D} AS d, {_SAME} AS same, list_has_any(b.toks, l.toks) AS t FROM s JOIN b ON b.id = s.bank_id JOIN l ON l.id = s.ledger_id)"""


#: One to one of a month; groups are then the loop of exact sums. A group holds what reached sums so far, in order.
_MONTH_PAIRS = f"SELECT month || tipo || cents AS grp, bank_id, ledger_id, (data_ref, bank_id) AS turn, row_number() OVER (PARTITION BY bank_id ORDER BY {_WISH}) AS wish FROM x WHERE cents = l_cents AND in_month AND score > 0"
_MONTHS_SQL = _scored_sql(False) + "," + _first_come_sql("m", _MONTH_PAIRS) + f""",
bf AS (SELECT * FROM b WHERE id NOT IN (SELECT bank_id FROM m)), lf AS (SELECT * FROM l WHERE id NOT IN (SELECT ledger_id FROM m)),
e AS (
  SELECT b.month || b.tipo AS grp, b.id AS bank_id, l.id AS ledger_id, b.cents AS target, l.cents, (b.data_ref, b.id) AS turn, {_CLOSE} AS close, l.tax, {_D} AS d, l.valor
  FROM bf b JOIN lf l ON b.month = l.month AND b.tipo = l.tipo AND l.valor < b.valor AND {_D} <= 45 AND CASE WHEN b.root <> '' THEN b.root = l.root ELSE b.federal AND l.tax END
  WHERE {_CLOSE} OR CASE WHEN b.federal THEN l.tax ELSE list_has_any(b.toks, l.toks) END),
gt AS (SELECT grp, bank_id, any_value(target) AS target, row_number() OVER (PARTITION BY grp ORDER BY any_value(turn)) AS k FROM e GROUP BY grp, bank_id HAVING count(*) > 1),
gr AS (
  SELECT DISTINCT grp, 0::BIGINT AS k, NULL::BIGINT AS bank_id, []::BIGINT[] AS got, []::BIGINT[] AS used FROM gt
  UNION ALL
  SELECT grp, k, bank_id, got, list_concat(used, got) FROM (
    SELECT grp, k + 1 AS k, bank_id, used, coalesce(list_filter(list_reduce(items, lambda a, i: list_concat(a, list_transform(list_filter(a, lambda y: y.s + i.c <= target AND NOT list_contains(list_transform(a, lambda z: z.s), y.s + i.c)),
      lambda y: {{'s': y.s + i.c, 'c': 0::BIGINT, 'ids': list_append(y.ids, i.ids[1])}})), [{{'s': 0::BIGINT, 'c': 0::BIGINT, 'ids': []::BIGINT[]}}]), lambda y: y.s = target)[1].ids, []) AS got
    FROM (
      SELECT r.grp, r.k, t.bank_id, any_value(r.used) AS used, any_value(t.target) AS target, list({{'s': 0::BIGINT, 'c': e.cents, 'ids': [e.ledger_id]}} ORDER BY NOT e.close, e.d, e.valor, e.ledger_id) FILTER (e.ledger_id IS NOT NULL) AS items
      FROM gr r JOIN gt t ON t.grp = r.grp AND t.k = r.k + 1 LEFT JOIN e ON e.bank_id = t.bank_id AND NOT list_contains(r.used, e.ledger_id) GROUP BY r.grp, r.k, t.bank_id))),
g AS (SELECT bank_id, got FROM gr WHERE len(got) > 0),
w AS (
  SELECT bank_id::VARCHAR AS bank_ids, ledger_id::VARCHAR AS ledger_ids, score, metodo, {_STATUS} AS status FROM m JOIN s USING (bank_id, ledger_id)
  UNION ALL SELECT g.bank_id::VARCHAR, array_to_string(got, ','), 98, CASE WHEN b.federal AND u.tax THEN 'AGRUPAMENTO_SISTEMA_TRIBUTO_CAIXA_VALOR' WHEN u.close THEN 'AGRUPAMENTO_SISTEMA_CNPJ_VALOR' ELSE 'AGRUPAMENTO_SISTEMA_VALOR' END, 'CONCILIADO'
    FROM g JOIN b ON b.id = g.bank_id JOIN (SELECT g.bank_id, bool_or(e.tax) AS tax, bool_or(e.close) AS close FROM g JOIN e ON e.bank_id = g.bank_id AND list_contains(g.got, e.ledger_id) GROUP BY 1) u ON u.bank_id = g.bank_id
  UNION ALL SELECT id::VARCHAR, '', 0, 'SEM_CORRESPONDENCIA', 'NAO_ENCONTRADO' FROM bf WHERE id NOT IN (SELECT bank_id FROM g))
"""
_NEAR_SQL = f""",
c AS (SELECT b.tipo || ':' || b.root AS grp, b.id AS bank_id, l.id AS ledger_id, (b.data_ref, b.id) AS turn, {_D} AS d, b.valor - l.valor AS diferenca, b.month = l.month AS in_month, l.no FROM bn b JOIN (SELECT *, row_number() OVER (PARTITION BY tipo, root, month ORDER BY data_ref, id) AS no FROM ln) l ON b.tipo = l.tipo AND b.root = l.root AND b.root <> ''),
n AS (SELECT bank_id FROM c WHERE d <= 3),
q AS (SELECT * FROM c WHERE diferenca <> 0 AND (d <= 3 OR in_month AND no <= 20 AND bank_id NOT IN (SELECT bank_id FROM n))),
""" + _first_come_sql("nm", "SELECT grp, bank_id, ledger_id, turn, row_number() OVER (PARTITION BY bank_id ORDER BY d, abs(diferenca), ledger_id::VARCHAR) AS wish FROM q").lstrip() + " SELECT bank_id, ledger_id, diferenca FROM nm JOIN q USING (bank_id, ledger_id)"


def _named(m: DataFrame) -> DataFrame:
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select(ids("bank_ids").alias("bank_ids"), ids("ledger_ids").alias("ledger_ids"), "score", "metodo", "status", "observacao")


@query(_MONTHS_SQL + "SELECT * FROM w")
def resolve_months_no_text(spark: SparkSession, sf: str) -> DataFrame:
    """All passes of the month engine; texts are compared by their words only, as SQL can."""
    return _named(resolve.resolve_months(bank(spark, sf), ledger(spark, sf), False, limits=False)).drop("observacao")


@query(_MONTHS_SQL + "SELECT metodo, status, count(*) AS qtd, sum(score)::BIGINT AS pontos FROM w GROUP BY ALL")
def resolve_months_summary_no_text(spark: SparkSession, sf: str) -> DataFrame:
    got = resolve.resolve_months(bank(spark, sf), ledger(spark, sf), False, limits=False)
    return got.groupBy("metodo", "status").agg(F.count("*").alias("qtd"), F.sum("score").cast("long").alias("pontos"))


@query(_MONTHS_SQL.rstrip() + ", bn AS (SELECT * FROM b WHERE id::VARCHAR NOT IN (SELECT bank_ids FROM w WHERE ledger_ids <> '')), ln AS (SELECT * FROM lf WHERE id NOT IN (SELECT unnest(got) FROM g))" + _NEAR_SQL.replace(" AND no <= 20", ""))
def near_matches_no_text(spark: SparkSession, sf: str) -> DataFrame:
    """Near matches of what the month engine (words only) leaves over."""
    b, l = bank(spark, sf), ledger(spark, sf)
    m = resolve.resolve_months(b, l, False, limits=False)
    return resolve.near_matches(reports.unmatched(b, m, "bank_ids"), reports.unmatched(l, m, "ledger_ids"), None)


@query(FEATURES.replace("WITH", "WITH RECURSIVE", 1).rstrip() + ", bn AS (SELECT * FROM b), ln AS (SELECT * FROM l)" + _NEAR_SQL)
def near_matches_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Near matches of the whole facts, matched or not."""
    return resolve.near_matches(bank(spark, sf), ledger(spark, sf))


@query(_scored_sql(True) + "," + _first_come_sql("m", "SELECT empresa_id AS grp, bank_id, ledger_id, (data_ref, bank_id) AS turn, row_number() OVER (PARTITION BY bank_id ORDER BY -score, l_data_ref, ledger_id) AS wish FROM x WHERE score > 0 AND empresa_id = l_empresa_id") + f" SELECT bank_id, ledger_id, score, metodo, {_STATUS} AS status FROM m JOIN s USING (bank_id, ledger_id)")
def account_best_of_rest_no_text(spark: SparkSession, sf: str) -> DataFrame:
    """The account engine's last pass by itself: every bank row in order takes its best free ledger row."""
    return resolve.best_of_rest_pairs(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf)), False).select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"), "score", "metodo", "status")


def _sums_sql(name: str, pairs: str, limit: int, cut: bool) -> str:
    """CTEs up to `name` (one, got): the loop over the rows `one` of each group, which take the first exact sum of their
    free rows. pairs: grp, one, many, turn, target, cents, place."""
    first = "{'s': 0::BIGINT, 'c': 0::BIGINT, 'ids': []::BIGINT[]}"
    return f"""
{name}_e AS ({pairs}),
{name}_t AS (SELECT grp, one, any_value(target) AS target, row_number() OVER (PARTITION BY grp ORDER BY any_value(turn)) AS k FROM {name}_e GROUP BY grp, one HAVING count(*) > 1),
{name}_r AS (
  SELECT DISTINCT grp, 0::BIGINT AS k, NULL::BIGINT AS one, []::BIGINT[] AS got, []::BIGINT[] AS used FROM {name}_t
  UNION ALL
  SELECT grp, k, one, got, list_concat(used, got) FROM (
    SELECT grp, k + 1 AS k, one, used, CASE WHEN {cut} OR len(items) <= {limit} THEN coalesce(list_filter(list_reduce(items[1:{limit}], lambda a, i: list_concat(a, list_transform(list_filter(a, lambda y: y.s + i.c <= target AND NOT list_contains(list_transform(a, lambda z: z.s), y.s + i.c)),
      lambda y: {{'s': y.s + i.c, 'c': 0::BIGINT, 'ids': list_append(y.ids, i.ids[1])}})), [{first}]), lambda y: y.s = target)[1].ids, []) ELSE [] END AS got
    FROM (
      SELECT r.grp, r.k, t.one, any_value(r.used) AS used, any_value(t.target) AS target, list({{'s': 0::BIGINT, 'c': e.cents, 'ids': [e.many]}} ORDER BY e.place) FILTER (e.many IS NOT NULL) AS items
      FROM {name}_r r JOIN {name}_t t ON t.grp = r.grp AND t.k = r.k + 1 LEFT JOIN {name}_e e ON e.one = t.one AND NOT list_contains(r.used, e.many) GROUP BY r.grp, r.k, t.one))),
{name} AS (SELECT one, got FROM {name}_r WHERE len(got) > 0)"""


def _account_groups_sql(side: int, on: str, grp: str, limit: int, cut: bool) -> str:
    one, many = ("b", "l") if side == 0 else ("l", "b")
    pairs = f"SELECT b.empresa_id || b.tipo || {grp} AS grp, {one}.id AS one, {many}.id AS many, ({one}.data_ref, {one}.id) AS turn, {one}.cents AS target, {many}.cents, ({_D}, {many}.valor, {many}.id) AS place FROM b JOIN l ON b.empresa_id = l.empresa_id AND b.tipo = l.tipo AND {many}.valor < {one}.valor AND {on}"
    return FEATURES.replace("WITH", "WITH RECURSIVE", 1).rstrip() + "," + _sums_sql("g", pairs, limit, cut) + " SELECT one, array_to_string(got, ',') AS many FROM g"


_BY_DOC, _BY_TAX = f"b.doc <> '' AND l.doc <> '' AND b.root = l.root AND {_D} <= 3 AND {_CLOSE}", f"b.federal AND l.tax AND {_D} <= 45"


def _sums(spark: SparkSession, sf: str, step: Callable[[DataFrame, DataFrame, int], DataFrame], side: int) -> DataFrame:
    got = step(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf)), side)
    one, many = ("bank_ids", "ledger_ids") if side == 0 else ("ledger_ids", "bank_ids")
    return got.select(F.col(one)[0].alias("one"), F.array_join(F.transform(many, lambda x: x.cast("string")), ",").alias("many"))


@query(_account_groups_sql(0, _BY_DOC, "b.root", 14, False))
def account_bank_rows_by_document(spark: SparkSession, sf: str) -> DataFrame:
    """Bank rows and the ledger rows of their document, near in date, that sum to them."""
    return _sums(spark, sf, resolve.by_document, 0)


@query(_account_groups_sql(1, _BY_DOC, "b.root", 14, False))
def account_ledger_rows_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return _sums(spark, sf, resolve.by_document, 1)


@query(_account_groups_sql(0, _BY_TAX, "''", 20, True))
def account_bank_rows_by_tax(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the federal bank and the tax entries of 45 days around that sum to them."""
    return _sums(spark, sf, resolve.by_tax, 0)


@query(_account_groups_sql(1, _BY_TAX, "''", 20, True))
def account_ledger_rows_by_tax(spark: SparkSession, sf: str) -> DataFrame:
    return _sums(spark, sf, resolve.by_tax, 1)


#: Best pairs first: a pair is taken in the step in which no better one of its rows is left.
@query(_scored_sql(True) + """,
k AS (SELECT x.bank_id, x.ledger_id, x.empresa_id || x.tipo || x.cents || b.doc AS grp, row_number() OVER (PARTITION BY x.empresa_id, x.tipo, x.cents, b.doc ORDER BY -score, d, NOT t, x.bank_id, x.ledger_id) AS no FROM x JOIN b ON b.id = x.bank_id WHERE x.same AND score >= 95 AND x.cents = l_cents AND x.empresa_id = l_empresa_id),
r AS (
  SELECT DISTINCT grp, 0::BIGINT AS step, NULL::BIGINT AS bank_id, NULL::BIGINT AS ledger_id, []::BIGINT[] AS bs, []::BIGINT[] AS ls FROM k
  UNION ALL
  SELECT r.grp, r.step + 1, arg_min(k.bank_id, k.no), arg_min(k.ledger_id, k.no), list_append(any_value(r.bs), arg_min(k.bank_id, k.no)), list_append(any_value(r.ls), arg_min(k.ledger_id, k.no))
  FROM r JOIN k ON k.grp = r.grp AND NOT list_contains(r.bs, k.bank_id) AND NOT list_contains(r.ls, k.ledger_id) GROUP BY r.grp, r.step)
SELECT r.bank_id, r.ledger_id, score, metodo FROM r JOIN s USING (bank_id, ledger_id)""")
def account_strong_pairs_no_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of equal document and value with 95 points or more, the best of all first."""
    got = resolve.strong_pairs(bank_features(bank(spark, sf)), ledger_features(ledger(spark, sf)), False)
    return got.select(F.col("b_id").alias("bank_id"), F.col("l_id").alias("ledger_id"), "score", "metodo")


@query(_MONTHS_SQL.rstrip() + " SELECT id AS banco_id, data_ref AS data, tipo, valor, documento, '' AS banco, '' AS conta, '' AS empresa, descricao FROM b WHERE id::VARCHAR IN (SELECT bank_ids FROM w WHERE ledger_ids = '')")
def report_bank_only_no_text(spark: SparkSession, sf: str) -> DataFrame:
    """Bank rows that the month engine (words only) leaves without a ledger row."""
    b = bank(spark, sf)
    return reports.bank_only(b, resolve.resolve_months(b, ledger(spark, sf), False, limits=False))


@query(_MONTHS_SQL.rstrip() + " SELECT id AS sistema_id, data_ref AS data, tipo, valor, documento, '' AS empresa, favorecido, descricao, '' AS categoria, '' AS centro_custo, '' AS sistema_origem FROM lf WHERE id NOT IN (SELECT unnest(got) FROM g)")
def report_ledger_only_no_text(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows that no match of the month engine (words only) holds."""
    l = ledger(spark, sf)
    return reports.ledger_only(l, resolve.resolve_months(bank(spark, sf), l, False, limits=False))


@query(FEATURES.replace("WITH", "WITH RECURSIVE", 1).rstrip() + ", bn AS (SELECT * FROM b), ln AS (SELECT * FROM l)" + _NEAR_SQL.replace(" SELECT bank_id, ledger_id, diferenca FROM nm JOIN q USING (bank_id, ledger_id)", f""" SELECT 'POSSIVEL_DIVERGENCIA_VALOR' AS status, b.id AS banco_id, b.data_ref AS banco_data, b.tipo AS banco_tipo, b.valor AS banco_valor, b.documento AS banco_documento, '' AS banco_banco, '' AS banco_conta, '' AS banco_empresa, b.descricao AS banco_descricao,
 l.id AS sistema_id, l.data_ref AS sistema_data, l.tipo AS sistema_tipo, l.valor AS sistema_valor, l.documento AS sistema_documento, '' AS sistema_empresa, trim(l.favorecido || ' - ' || l.descricao, ' -') AS sistema_favorecido_descricao, '' AS sistema_categoria, '' AS sistema_centro_custo, '' AS sistema_origem,
 diferenca::DECIMAL(18,2) AS diferenca_valor, '{fixed.NOTE_NEAR}' AS observacao FROM nm JOIN q USING (bank_id, ledger_id) JOIN b ON b.id = bank_id JOIN l ON l.id = ledger_id"""))
def report_near_rows_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows of the near matches of the whole facts."""
    b, l = bank(spark, sf), ledger(spark, sf)
    return reports.near_rows(resolve.near_matches(b, l), b, l)


@query()
def resolve_months(spark: SparkSession, sf: str) -> DataFrame:
    return _named(resolve.resolve_months(bank(spark, sf), ledger(spark, sf)))


@query()
def resolve_account(spark: SparkSession, sf: str) -> DataFrame:
    return _named(resolve.resolve_account(bank(spark, sf), ledger(spark, sf)))


@query()
def near_matches(spark: SparkSession, sf: str) -> DataFrame:
    b, l = bank(spark, sf), ledger(spark, sf)
    m = resolve.resolve_months(b, l)
    return resolve.near_matches(reports.unmatched(b, m, "bank_ids"), reports.unmatched(l, m, "ledger_ids"))


@query()
def report_matches(spark: SparkSession, sf: str) -> DataFrame:
    b, l = bank(spark, sf), ledger(spark, sf)
    return reports.match_rows(resolve.resolve_months(b, l), b, l)


@query()
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    b, l = bank(spark, sf), ledger(spark, sf)
    return reports.summary(resolve.resolve_months(b, l), b, l)


# --- loading



@query("""SELECT 'CLINUX:PAGAMENTO:' || (l_orderkey * 10 + l_linenumber) AS identificador_externo, l_shipdate::DATE AS data_ref, CASE WHEN l_returnflag = 'R' THEN 'SAIDA' WHEN l_returnflag = 'A' THEN 'ENTRADA' ELSE CASE WHEN l_linestatus = 'F' THEN 'ENTRADA' ELSE 'SAIDA' END END AS tipo,
 l_extendedprice::DECIMAL(18,2) AS valor, l_linestatus AS descricao FROM lineitem""")
def etl_payments(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("l_extendedprice").cast(values.MONEY)
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    p = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cd_pagamento"), F.col("l_shipdate").alias("dt_realizacao"), F.when(F.col("l_linenumber") > 1, v).alias("nr_realizado"), F.when(F.col("l_linenumber") == 1, v).alias("nr_pagamento"), F.lit(0).alias("nr_previsto"), F.col("l_linestatus").alias("ds_tipo"), flag.alias("sn_despesa"), F.lit(" ").alias("ds_documento"), F.col("l_linestatus").alias("ds_historico"))
    return etl.ledger_from_payments(p).drop("metadados")




@query("SELECT count(*) AS brutas, (SELECT count(*) FROM orders) AS unicas FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def etl_dedup_overlap(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("conta"), F.col("o_orderdate").cast("date").alias("data"), F.lit("SAIDA").alias("tipo"), F.col("o_totalprice").cast(values.MONEY).alias("valor"), F.concat(F.lit("Pagamento nº "), F.col("o_orderkey")).alias("descricao"), F.lit(None).cast("string").alias("documento"))
    both = o.withColumn("arquivo", F.lit("f1")).unionByName(o.where("o_orderkey % 2 = 0").withColumn("arquivo", F.lit("f2")))
    keyed = etl.dedup_key(both, "arquivo", ["o_orderkey"], ["conta"])
    return keyed.agg(F.count("*").alias("brutas"), F.countDistinct("dedup_key").alias("unicas"))


@query("SELECT o_orderkey AS id, o_totalprice::DECIMAL(18,2) AS valor FROM orders WHERE o_orderkey % 3 <> 0")
def etl_idempotent_append(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast(values.MONEY).alias("valor"))
    return etl.append_new(o.where("id % 3 = 0"), o.unionByName(o.where("id % 5 = 0")), ["id"])


@query("SELECT o_custkey AS empresa_id, o_orderdate::DATE AS data_ref, CASE WHEN o_orderkey % 2 = 0 THEN 'ENTRADA' ELSE 'SAIDA' END AS tipo, o_totalprice::DECIMAL(18,2) AS valor, NULL::VARCHAR AS documento FROM orders WHERE o_orderkey % 3 <> 0")
def etl_null_safe_append(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("empresa_id"), F.col("o_orderdate").cast("date").alias("data_ref"), F.when(F.col("o_orderkey") % 2 == 0, "ENTRADA").otherwise("SAIDA").alias("tipo"), F.col("o_totalprice").cast(values.MONEY).alias("valor"), F.lit(None).cast("string").alias("documento"), F.col("o_orderkey").alias("k"))
    return etl.append_by_content(o.where("k % 3 = 0").drop("k").withColumn("documento", F.lit("")), o.drop("k"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'NOVO' ELSE c_name END AS nome, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN '{"a":"1","b":"9","c":"3"}' ELSE '{"a":"1","b":"2"}' END AS meta FROM customer
UNION ALL SELECT -c_custkey - 1, 'NOVO', '{"b":"9","c":"3"}' FROM customer WHERE c_custkey % 4 = 0""")
def etl_upsert_json_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), F.lit('{"a":"1","b":"2"}').alias("meta"))
    new = c.where("c_custkey % 4 = 0").select(F.explode(F.array(F.col("c_custkey"), -F.col("c_custkey") - 1)).alias("id"), F.lit("NOVO").alias("nome"), F.lit('{"b":"9","c":"3"}').alias("meta"))
    return etl.upsert(old, new, ["id"], "meta")


@query(SQL + "SELECT count(*) FILTER (WHERE data_ref < DATE '1995-09-01') AS qtd_antes, sum(valor) FILTER (WHERE data_ref < DATE '1995-09-01')::DECIMAL(28,2) AS total_antes, count(*) FILTER (WHERE data_ref >= DATE '1995-09-01') AS qtd_depois, sum(valor) FILTER (WHERE data_ref >= DATE '1995-09-01')::DECIMAL(28,2) AS total_depois FROM bank")
def etl_retention_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return etl.retention_totals(bank(spark, sf), "data_ref", "1995-09-01")


@query("SELECT o_orderkey % 2 AS lado, count(*) AS qtd FROM orders WHERE o_totalprice > 0 AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def etl_rejects(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = etl.valid(read(spark, sf, "orders"), {"valor": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus").isin("F", "O")})
    return ok.groupBy((F.col("o_orderkey") % 2).alias("lado")).agg(F.count("*").alias("qtd"))


# --- windows


@query("SELECT event_id, last_value(CASE WHEN event_id % 10 = 0 THEN ts::DATE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS data FROM events")
def window_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_id") % 10 == 0, F.col("ts").cast("date")), ignorenulls=True).over(w).alias("data"))


@query("WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grupo FROM events) SELECT user_id, grupo::BIGINT AS grupo, count(*) AS linhas, min(event_id) AS primeira FROM g GROUP BY user_id, grupo")
def window_line_groups(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf, "events").withColumn("grupo", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "grupo").agg(F.count("*").alias("linhas"), F.min("event_id").alias("primeira"))


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 1")
def window_first_sample(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_of_each(read(spark, sf, "customer"), "c_nationkey", ["c_custkey"]).select("c_nationkey", "c_custkey", "c_name")
