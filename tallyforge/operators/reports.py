"""Reports on facts and matches: totals, pivots, duplicates, match rows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import fixed, text, values

MONEY = values.MONEY
# Columns of the report of matches.
MATCH_COLUMNS = [
    "status", "score", "metodo", "banco_id", "banco_data", "banco_tipo", "banco_valor", "banco_documento", "banco_banco", "banco_conta", "banco_empresa", "banco_descricao", "sistema_id", "sistema_data", "sistema_tipo", "sistema_valor",
    "sistema_documento", "sistema_empresa", "sistema_favorecido_descricao", "sistema_categoria", "sistema_centro_custo", "sistema_origem", "diferenca_valor", "observacao",
]
# Columns of the reports of rows without a match, and where a fact's columns are called otherwise.
BANK_ONLY_COLUMNS = ["banco_id", "data", "tipo", "valor", "documento", "banco", "conta", "empresa", "descricao"]
LEDGER_ONLY_COLUMNS = ["sistema_id", "data", "tipo", "valor", "documento", "empresa", "favorecido", "descricao", "categoria", "centro_custo", "sistema_origem"]
NEAR_COLUMNS = [c for c in MATCH_COLUMNS if c not in ("score", "metodo")]
NEAR_STATUS = "POSSIVEL_DIVERGENCIA_VALOR"
_SOURCES = {"banco_id": "id", "sistema_id": "id", "data": "data_ref", "banco": "banco_nome"}


def _if(cond: str, col: str = "valor") -> F.Column:
    return F.coalesce(F.sum(F.when(F.expr(cond), F.col(col))), F.lit(0).cast(MONEY))


def by_origin(df: DataFrame, origin: str) -> DataFrame:
    return df.groupBy(F.coalesce(origin, F.lit("SEM_ORIGEM")).alias("origem")).agg(F.count("*").alias("qtd"), F.sum("valor").alias("total"), F.min("data_ref").alias("primeira"), F.max("data_ref").alias("ultima"))


def conditional_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("qtd"), _if("tipo = 'ENTRADA'").alias("entradas"), _if("tipo = 'SAIDA'").alias("saidas"), F.min("data_ref").alias("primeira"), F.max("data_ref").alias("ultima"))


def by_unit(df: DataFrame, unit: str) -> DataFrame:
    return df.groupBy(unit).agg(
        F.count_if(F.col("tipo") == "ENTRADA").alias("qtd_entradas"), F.count_if(F.col("tipo") == "SAIDA").alias("qtd_saidas"), _if("tipo = 'ENTRADA'").alias("entradas"), _if("tipo = 'SAIDA'").alias("saidas"),
        F.sum(F.when(F.col("tipo") == "ENTRADA", F.col("valor")).otherwise(-F.col("valor"))).alias("saldo"),
    )


def by_period_and_kind(df: DataFrame, period: str) -> DataFrame:
    return df.groupBy(F.date_trunc(period, "data_ref").cast("date").alias("periodo"), "tipo").agg(F.count("*").alias("qtd"), F.sum("valor").alias("total"))


def repetitions(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """How often each document, kind, value and month occurs on both sides."""
    key = [text.digits("documento").alias("doc"), F.col("tipo"), values.cents("valor").alias("cents"), F.date_format("data_ref", "yyyy-MM").alias("mes")]
    both = bank.select(F.lit(1).alias("b"), F.lit(0).alias("l"), *key).unionByName(ledger.select(F.lit(0).alias("b"), F.lit(1).alias("l"), *key))
    return both.where("doc <> ''").groupBy("doc", "tipo", "cents", "mes").agg(F.sum("b").cast("long").alias("qtd_banco"), F.sum("l").cast("long").alias("qtd_sistema"))


def duplicates(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of one side that share month, kind, value and document root, or else the first six words; ids in order of
    date and id."""

    def keyed(df: DataFrame, side: str, words: F.Column) -> DataFrame:
        first = F.array_join(F.slice(F.split(text.normalize(words), " "), 1, 6), " ")
        root = text.doc_root("documento")
        return df.select(F.lit(side).alias("origem"), F.date_format("data_ref", "yyyy-MM").alias("periodo"), "tipo", values.cents("valor").alias("cents"), F.when(root != "", root).otherwise(first).alias("chave"), F.struct("data_ref", "id").alias("at"))

    rows = keyed(bank, "BANCO", F.col("descricao")).unionByName(keyed(ledger, "SISTEMA", text.joined("favorecido", "descricao")))
    got = rows.groupBy("origem", "periodo", "tipo", "cents", "chave").agg(F.count("*").alias("quantidade"), F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["id"].cast("string")), ", ").alias("ids"))
    return got.where("quantidade >= 2").select("origem", "periodo", "tipo", (F.col("cents").cast("decimal(20,0)") / 100).cast(MONEY).alias("valor"), "quantidade", "ids", "chave", F.lit(fixed.NOTE_DUPLICATE).alias("observacao"))


def match_rows(matches: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """One report row for each match with a ledger row: ids in group order, sorted distinct dates and documents, sums
    and difference; names of the first row of a side. Columns that a fact lacks are ''."""

    def side(ids: str, facts: DataFrame, words: F.Column, first: dict[str, str], p: str, label: str) -> DataFrame:
        known = {a: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in facts.columns else F.lit("") for a, c in first.items()}
        facts = facts.select("id", "data_ref", "valor", "documento", words.alias("text"), F.struct(*(c.alias(a) for a, c in known.items())).alias("first"))
        one = matches.select("key", F.posexplode(ids).alias("pos", "id")).join(facts.hint("merge"), "id")
        listed = F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id"), "text", "first")))
        got = one.groupBy("key").agg(
            listed.alias("rows"), F.array_join(F.array_sort(F.collect_set(F.col("data_ref").cast("string"))), ", ").alias(f"{p}_data"), F.sum("valor").cast(MONEY).alias(f"{p}_valor"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("documento") != "", F.col("documento")))), ", ").alias(f"{p}_documento"),
        )
        texts = F.filter(F.transform("rows", lambda s: s["text"]), lambda x: x != "")
        return got.select("key", F.array_join(F.transform("rows", lambda s: s["id"]), ", ").alias(f"{p}_id"), F.array_join(texts, " | ").alias(label), *(F.col("rows")[0]["first"][a].alias(a) for a in first), f"{p}_data", f"{p}_valor", f"{p}_documento")

    # A bank row is in one match only, so the first one names it.
    matches = matches.where(F.size("ledger_ids") > 0).withColumn("key", F.col("bank_ids")[0])
    b = side("bank_ids", bank, F.coalesce("descricao", F.lit("")), {"banco_tipo": "tipo", "banco_banco": "banco_nome", "banco_conta": "conta", "banco_empresa": "empresa"}, "banco", "banco_descricao")
    both = F.concat_ws(" - ", F.when(F.col("favorecido") != "", F.col("favorecido")), F.when(F.col("descricao") != "", F.col("descricao")))
    names = {"sistema_tipo": "tipo", "sistema_empresa": "empresa", "sistema_categoria": "categoria", "sistema_centro_custo": "centro_custo", "sistema_origem": "sistema_origem"}
    l = side("ledger_ids", ledger, both, names, "sistema", "sistema_favorecido_descricao")
    note = F.when((F.col("status") == "CONCILIADO_VALOR_IGUAL") & (F.coalesce("observacao", F.lit("")) == ""), fixed.NOTE_EQUAL_VALUE_ONLY).otherwise(F.col("observacao"))
    got = matches.join(b.hint("merge"), "key", "left").join(l.hint("merge"), "key", "left").withColumn("diferenca_valor", (F.col("banco_valor") - F.col("sistema_valor")).cast(MONEY)).withColumn("observacao", note)
    return got.select(*MATCH_COLUMNS)


def links(matches: DataFrame) -> DataFrame:
    """bank_id, ledger_id of every link of a match."""
    return matches.select("score", "metodo", "status", F.explode("bank_ids").alias("bank_id"), "ledger_ids").select("bank_id", F.explode("ledger_ids").alias("ledger_id"), "score", "metodo", "status")


def unmatched(facts: DataFrame, matches: DataFrame, ids: str) -> DataFrame:
    used = matches.where(F.size("ledger_ids") > 0).select(F.explode(ids).alias("id"))
    return facts.join(used.hint("merge"), "id", "left_anti")


def _report(facts: DataFrame, columns: list[str]) -> DataFrame:
    return facts.select(*(F.col(_SOURCES.get(c, c)).alias(c) if _SOURCES.get(c, c) in facts.columns else F.lit("").alias(c) for c in columns))


def bank_only(bank: DataFrame, matches: DataFrame) -> DataFrame:
    """Report rows of the bank that no ledger row answers. Columns that the fact lacks are ''."""
    return _report(unmatched(bank, matches, "bank_ids"), BANK_ONLY_COLUMNS)


def ledger_only(ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """Report rows of the ledger that no match holds. Columns that the fact lacks are ''."""
    return _report(unmatched(ledger, matches, "ledger_ids"), LEDGER_ONLY_COLUMNS)


def near_rows(near: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Report rows of near matches (bank_id, ledger_id, diferenca): both sides as they are in their own reports."""
    both = ["documento", "empresa", "data", "tipo", "valor"]
    b = _report(bank, BANK_ONLY_COLUMNS).select("banco_id", *(F.col(c).alias(f"banco_{c}") for c in (*both, "banco", "conta", "descricao")))
    # Payee and description joined; blanks and dashes at the ends go.
    said = F.btrim(F.concat(F.coalesce("favorecido", F.lit("")), F.lit(" - "), F.coalesce("descricao", F.lit(""))), F.lit(" -"))
    l = _report(ledger, LEDGER_ONLY_COLUMNS).select("sistema_id", *(F.col(c).alias(f"sistema_{c}") for c in (*both, "categoria", "centro_custo")), said.alias("sistema_favorecido_descricao"), "sistema_origem")
    got = near.join(b.hint("merge"), near["bank_id"] == b["banco_id"]).join(l.hint("merge"), near["ledger_id"] == l["sistema_id"])
    got = got.withColumns({"status": F.lit(NEAR_STATUS), "diferenca_valor": F.col("diferenca"), "observacao": F.lit(fixed.NOTE_NEAR)})
    return got.select(*NEAR_COLUMNS)


def report_set(matches: DataFrame, near: DataFrame, bank: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """The eight reports of a run by the names of their files. matches and near are read several times: give tables."""
    rows = match_rows(matches, bank, ledger)
    # Names of the files.
    return {
        "01_resumo": summary(matches, bank, ledger), "02_conciliados": rows, "03_valor_igual_validar": rows.where("status = 'CONCILIADO_VALOR_IGUAL'"), "04_divergencias": rows.where("status = 'DIVERGENCIA'"),
        "05_banco_sem_sistema": bank_only(bank, matches), "06_sistema_sem_banco": ledger_only(ledger, matches), "07_duplicidades": duplicates(bank, ledger), "08_possiveis_divergencias_valor": near_rows(near, bank, ledger),
    }


def summary(matches: DataFrame, bank: DataFrame, ledger: DataFrame, start: str = "2025-09-01", end: str = "2026-09-01") -> DataFrame:
    """indicador, valor: counts and totals of both sides, of the matches' statuses and of what has no match."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{p}n"), _if("tipo = 'ENTRADA'").cast(MONEY).alias(f"{p}e"), _if("tipo = 'SAIDA'").cast(MONEY).alias(f"{p}s"))

    status = {"both": "CONCILIADO", "equal": "CONCILIADO_VALOR_IGUAL", "maybe": "POSSIVEL_CORRESPONDENCIA", "review": "POSSIVEL_REVISAO", "apart": "DIVERGENCIA", "none": "NAO_ENCONTRADO"}
    of = matches.agg(*(F.count_if(F.col("status") == v).alias(k) for k, v in status.items()), F.coalesce(F.sum(F.size("ledger_ids")), F.lit(0)).alias("used"))
    one = side(bank, "b").crossJoin(side(ledger, "l")).crossJoin(of)  # three single rows
    done = F.col("both") + F.col("equal")
    values_ = (
        ("Periodo analisado", F.lit(f"{start} a {end}")), ("Quantidade Banco", F.col("bn")), ("Quantidade Sistema", F.col("ln")), ("Banco entradas", F.col("be")), ("Banco saidas", F.col("bs")), ("Sistema entradas", F.col("le")),
        ("Sistema saidas", F.col("ls")), ("Conciliados", done), ("Conciliados por valor igual para validar", F.col("equal")), ("Possiveis correspondencias", F.col("maybe")), ("Possiveis revisoes", F.col("review")),
        ("Divergencias", F.col("apart")), ("Banco sem Sistema", F.col("none")), ("Sistema sem Banco", F.col("ln") - F.col("used")), ("% Banco conciliado", F.format_string("%.4f", F.when(F.col("bn") > 0, done / F.col("bn")).otherwise(0.0))),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("indicador"), v.cast("string").alias("valor")) for n, v in values_))).alias("x")).select("x.*")


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
