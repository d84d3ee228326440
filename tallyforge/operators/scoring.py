"""Scores of candidate pairs as ordered conditions, and their classes.

`supplier` says whether the texts may name the same payee: tokens in common, or text similarity of at
least 0.35. Similarity runs in Python, so it is asked for only where no cheaper rule has decided.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import fixed, text
from tallyforge.operators.candidates import days

# Scores and methods of the rules, in order.
RULES = {
    "CNPJ_VALOR_DATA": 100, "CNPJ_VALOR_DATA_APROXIMADA": 95, "CNPJ_VALOR_FORNECEDOR_DATA_DIFERENTE": 96, "CNPJ_VALOR_DATA_DIFERENTE": 88, "VALOR_TRIBUTO_CAIXA_DATA": 94, "VALOR_TRIBUTO_CAIXA_MES": 92,
    "VALOR_TRIBUTO_CAIXA_DATA_DIFERENTE": 86, "VALOR_DATA_TEXTO": 90, "VALOR_DATA_TEXTO_APROXIMADA": 85, "VALOR_FORNECEDOR_DATA_DIFERENTE": 82, "VALOR_DATA": 80, "VALOR_DATA_APROXIMADA": 75,
    "VALOR_IGUAL_PALAVRAS_RELACIONADAS_INFO_DIFERENTE": 74, "VALOR_IGUAL_INFO_DIFERENTE": 70, "CNPJ_DATA_VALOR_DIFERENTE": 60, "TIPO_DIFERENTE": 0, "SEM_CORRESPONDENCIA": 0,
}
DIVERGENT = "CNPJ_DATA_VALOR_DIFERENTE"


def tokens_in_common() -> Column:
    return F.arrays_overlap("b_toks", "l_toks")


def with_supplier(pairs: DataFrame, use_similarity: bool = True) -> DataFrame:
    """Adds supplier. Similarity is computed only for pairs of equal value without common tokens."""
    if not use_similarity:
        return pairs.withColumn("supplier", tokens_in_common())
    ask = (F.col("b_cents") == F.col("l_cents")) & ~tokens_in_common()
    sim = text.similarity(F.when(ask, F.col("b_norm")).otherwise(""), F.when(ask, F.col("l_norm")).otherwise(""))
    return pairs.withColumn("_sim", sim).withColumn("supplier", tokens_in_common() | (F.col("_sim") >= fixed.TEXT_SIMILARITY)).drop("_sim")


def _method(by_account: bool) -> Column:
    d, near = days(), days() <= fixed.NEAR_DAYS
    kind, value = F.col("b_tipo") == F.col("l_tipo"), F.col("b_cents") == F.col("l_cents")
    same = (F.col("b_doc") != "") & (F.col("b_doc") == F.col("l_doc"))
    close = same | ((F.length("b_doc") == 14) & (F.length("l_doc") == 14) & (F.col("b_root") == F.col("l_root")))
    tax = F.col("b_federal") & F.col("l_tax")
    supplier, related = F.col("supplier"), text.relation(F.col("b_toks"), F.col("l_toks")) != ""
    doc = same if by_account else close
    late = F.when(d <= fixed.SUPPLIER_DAYS, "VALOR_TRIBUTO_CAIXA_MES").otherwise("VALOR_TRIBUTO_CAIXA_DATA_DIFERENTE") if by_account else F.lit("VALOR_TRIBUTO_CAIXA_MES")
    return (
        F.when(~kind, "TIPO_DIFERENTE")
        .when(~value, F.when(doc & near, DIVERGENT).otherwise("SEM_CORRESPONDENCIA"))
        .when(same & (d == 0), "CNPJ_VALOR_DATA").when(same & near, "CNPJ_VALOR_DATA_APROXIMADA").when(doc & supplier, "CNPJ_VALOR_FORNECEDOR_DATA_DIFERENTE").when(doc, "CNPJ_VALOR_DATA_DIFERENTE")
        .when(tax & near, "VALOR_TRIBUTO_CAIXA_DATA").when(tax, late)
        .when(supplier & (d == 0), "VALOR_DATA_TEXTO").when(supplier & near, "VALOR_DATA_TEXTO_APROXIMADA").when(supplier, "VALOR_FORNECEDOR_DATA_DIFERENTE")
        .when(d == 0, "VALOR_DATA").when(near, "VALOR_DATA_APROXIMADA").when(related, "VALOR_IGUAL_PALAVRAS_RELACIONADAS_INFO_DIFERENTE").otherwise("VALOR_IGUAL_INFO_DIFERENTE")
    )


def _points(method: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    return F.element_at(table, method)


def classify(score: Column, method: Column) -> Column:
    return (
        F.when(method == DIVERGENT, "DIVERGENCIA").when(score >= 95, "CONCILIADO")
        .when((score >= 70) & (method.startswith("VALOR_") | (method == "CNPJ_VALOR_DATA_DIFERENTE")), "CONCILIADO_VALOR_IGUAL")
        .when(score >= 80, "POSSIVEL_CORRESPONDENCIA").when(score >= 70, "POSSIVEL_REVISAO").otherwise("NAO_ENCONTRADO")
    )


def _scored(pairs: DataFrame, by_account: bool, use_similarity: bool) -> DataFrame:
    out = with_supplier(pairs, use_similarity).withColumn("metodo", _method(by_account)).withColumn("score", _points(F.col("metodo")))
    return out.withColumn("status", classify(F.col("score"), F.col("metodo")))


def score_account(pairs: DataFrame, use_similarity: bool = True) -> DataFrame:
    """The dialect for one account and company: documents are compared in full. Adds metodo, score, status."""
    return _scored(pairs, True, use_similarity)


def score_month(pairs: DataFrame, use_similarity: bool = True) -> DataFrame:
    """The dialect for all accounts of a month: company numbers of one root are compatible."""
    return _scored(pairs, False, use_similarity)


def points_of_equal_value(gap: np.ndarray, same: np.ndarray, close: np.ndarray, supplier: np.ndarray, related: np.ndarray, tax: np.ndarray) -> np.ndarray:
    """Scores of the month dialect for pairs of equal kind and value, by the same rules."""
    on, near = gap == 0, gap <= fixed.NEAR_DAYS
    rules = (
        (same & on, "CNPJ_VALOR_DATA"), (same & near, "CNPJ_VALOR_DATA_APROXIMADA"), (close & supplier, "CNPJ_VALOR_FORNECEDOR_DATA_DIFERENTE"), (close, "CNPJ_VALOR_DATA_DIFERENTE"),
        (tax & near, "VALOR_TRIBUTO_CAIXA_DATA"), (tax, "VALOR_TRIBUTO_CAIXA_MES"), (supplier & on, "VALOR_DATA_TEXTO"), (supplier & near, "VALOR_DATA_TEXTO_APROXIMADA"), (supplier, "VALOR_FORNECEDOR_DATA_DIFERENTE"),
        (on, "VALOR_DATA"), (near, "VALOR_DATA_APROXIMADA"), (related, "VALOR_IGUAL_PALAVRAS_RELACIONADAS_INFO_DIFERENTE"),
    )
    return np.select([c for c, _ in rules], [RULES[m] for _, m in rules], RULES["VALOR_IGUAL_INFO_DIFERENTE"])


Score = Callable[[dict, dict], tuple[int, str]]


def score_pair(b: dict, l: dict, supplier: Callable[[dict, dict], bool], related: Callable[[dict, dict], bool], by_account: bool) -> tuple[int, str]:
    """The same rules for two rows, for the resolvers: (score, method)."""

    def method() -> str:
        if b["tipo"] != l["tipo"]:
            return "TIPO_DIFERENTE"
        d = abs((b["data_ref"] - l["data_ref"]).days)
        same = b["doc"] != "" and b["doc"] == l["doc"]
        doc = same or (not by_account and len(b["doc"]) == 14 == len(l["doc"]) and b["root"] == l["root"])
        if b["cents"] != l["cents"]:
            return DIVERGENT if doc and d <= fixed.NEAR_DAYS else "SEM_CORRESPONDENCIA"
        if same and d <= fixed.NEAR_DAYS:
            return "CNPJ_VALOR_DATA" if d == 0 else "CNPJ_VALOR_DATA_APROXIMADA"
        if doc:
            return "CNPJ_VALOR_FORNECEDOR_DATA_DIFERENTE" if supplier(b, l) else "CNPJ_VALOR_DATA_DIFERENTE"
        if b["federal"] and l["tax"]:
            late = "VALOR_TRIBUTO_CAIXA_DATA_DIFERENTE" if by_account and d > fixed.SUPPLIER_DAYS else "VALOR_TRIBUTO_CAIXA_MES"
            return "VALOR_TRIBUTO_CAIXA_DATA" if d <= fixed.NEAR_DAYS else late
        step = 0 if d == 0 else 1 if d <= fixed.NEAR_DAYS else 2
        if supplier(b, l):
            return ("VALOR_DATA_TEXTO", "VALOR_DATA_TEXTO_APROXIMADA", "VALOR_FORNECEDOR_DATA_DIFERENTE")[step]
        if step < 2:
            return ("VALOR_DATA", "VALOR_DATA_APROXIMADA")[step]
        return "VALOR_IGUAL_PALAVRAS_RELACIONADAS_INFO_DIFERENTE" if related(b, l) else "VALOR_IGUAL_INFO_DIFERENTE"

    m = method()
    return RULES[m], m


def class_of(score: int, method: str) -> str:
    if method == DIVERGENT:
        return "DIVERGENCIA"
    if score >= 95:
        return "CONCILIADO"
    if score >= 70 and (method.startswith("VALOR_") or method == "CNPJ_VALOR_DATA_DIFERENTE"):
        return "CONCILIADO_VALOR_IGUAL"
    return "POSSIVEL_CORRESPONDENCIA" if score >= 80 else "POSSIVEL_REVISAO" if score >= 70 else "NAO_ENCONTRADO"
