"""The ERP's payments and transfers: joins with their dimensions, ledger rows, import totals and audits.

Tables keep the ERP's column names. Dimensions are joined plainly, so Spark broadcasts those that its size limit allows
and merges the others. Days are bounds of a closed range. A null company is a company of its own in totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import values
from tallyforge.operators.etl import PAYMENT_ID, TRANSFER_ID

# Origins, groups and statuses.
PAYMENTS, TRANSFERS, REVENUE = "CLINUX", "CLINUX_TRANSFERENCIA", "RECEITAS"
BETWEEN_ACCOUNTS = "TRANSFERENCIA ENTRE CONTAS"
IMPORTED, NOT_IMPORTED = "IMPORTADA", "NAO IMPORTADA: sem pagamento realizado ou transferencia no periodo"
KINDS = ("ENTRADA", "SAIDA")

Tables = dict[str, DataFrame]


def _zero() -> Column:
    return F.lit(0).cast(values.MONEY)


def due() -> Column:
    """What a payment is worth: realised, else paid, else foreseen, else 0."""
    return F.coalesce("nr_realizado", "nr_pagamento", "nr_previsto", _zero())


def moved() -> Column:
    """The day of a transfer."""
    return F.coalesce("dt_conciliacao", "dt_lancamento", "dt_emissao", "dt_previsao")


def _sum_if(cond: Column, col: str = "valor") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)")


def payments(t: Tables, first: str, last: str, companies: list[int] | None = None, above: int | None = None) -> DataFrame:
    """Payments of the days whose value is not 0, with their entry and seven dimensions. A payment of several transfers
    comes once for each: `once` keeps the first."""
    p = t["pagamentos"].where(F.col("dt_realizacao").between(first, last) & (due() != 0))
    e = t["lancamentos"]
    if above is not None:
        p = p.where(F.col("cd_pagamento") > above)
    if companies:
        e = e.where(F.col("cd_empresa").isin(companies))
    p = p.select("cd_pagamento", "cd_lancamento", "dt_realizacao", "dt_vencimento", due().alias("valor"), F.col("ds_tipo").alias("tipo_pagamento"), "cd_banco", "sn_previsto")
    e = e.select("cd_lancamento", "cd_empresa", "cd_fornecedor", "cd_conta", "cd_centro", "dt_emissao", F.col("ds_tipo").alias("tipo_lancamento"), "ds_documento", "ds_historico", "sn_fechado")
    dims = [
        (t["empresas"].select("cd_empresa", "ds_empresa", F.col("ds_razao").alias("empresa_razao"), F.col("ds_cnpj").alias("empresa_cnpj")), "cd_empresa"),
        (t["fornecedores"].select("cd_fornecedor", "ds_fornecedor", F.col("ds_razao").alias("fornecedor_razao"), F.col("ds_cnpj").alias("fornecedor_cnpj")), "cd_fornecedor"),
        (t["contas"].select("cd_conta", "ds_conta", "cd_grupo"), "cd_conta"), (t["contas_grupos"].select("cd_grupo", "ds_grupo", "sn_despesa"), "cd_grupo"), (t["centro_custos"].select("cd_centro", "ds_centro"), "cd_centro"),
        (t["bancos"].select("cd_banco", "ds_banco"), "cd_banco"), (t["bancos_transfere"].where("cd_pagamento is not null").select("cd_pagamento", "cd_transferencia"), "cd_pagamento"),
    ]
    out = p.join(e, "cd_lancamento")
    for dim, key in dims:
        out = out.join(dim, key, "left")
    return out


def once(rows: DataFrame) -> DataFrame:
    """One row of each payment: that of its smallest transfer."""
    w = Window.partitionBy("cd_pagamento").orderBy(F.asc_nulls_last("cd_transferencia"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def transfers(t: Tables, first: str, last: str, companies: list[int] | None = None, above: int | None = None) -> DataFrame:
    """Transfers of the days whose value is not 0, with bank and company of both sides."""
    x = t["bancos_transfere"].where(moved().between(first, last) & (F.col("nr_valor") != 0))
    if above is not None:
        x = x.where(F.col("cd_transferencia") > above)
    x = x.select("cd_transferencia", moved().alias("data_movimento"), "nr_valor", "ds_historico", "cd_banco_src", "cd_banco_dst", "cd_pagamento", "cd_centro")
    for bank, side in (("cd_banco_src", "origem"), ("cd_banco_dst", "destino")):
        x = x.join(t["bancos"].select(F.col("cd_banco").alias(bank), F.col("ds_banco").alias(f"banco_{side}"), F.col("cd_empresa").alias(f"empresa_{side}")), bank, "left")
        x = x.join(t["empresas"].select(F.col("cd_empresa").alias(f"empresa_{side}"), F.col("ds_empresa").alias(f"unidade_{side}"), F.col("ds_razao").alias(f"razao_{side}"), F.col("ds_cnpj").alias(f"cnpj_{side}")), f"empresa_{side}", "left")
    if companies:
        x = x.where(F.col("empresa_origem").isin(companies) | F.col("empresa_destino").isin(companies))
    return x


def ledger(pays: DataFrame, moves: DataFrame) -> DataFrame:
    """Ledger rows of both: a payment is one row, a transfer one at each side."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    note = F.concat(F.coalesce("ds_historico", F.lit("")), F.when(F.col("ds_banco") != "", F.concat(F.lit(" | Banco Clinux: "), "ds_banco")).otherwise(""))
    a = pays.select(
        F.concat(F.lit(PAYMENT_ID), F.col("cd_pagamento").cast("string")).alias("identificador_externo"), "cd_empresa", F.col("ds_empresa").alias("unidade"), F.coalesce("dt_emissao", "dt_realizacao").alias("data_lancamento"), "dt_vencimento", F.col("dt_realizacao").alias("data_pagamento"),
        values.kind_erp("sn_despesa", "tipo_lancamento").alias("tipo"), F.abs("valor").cast(values.MONEY).alias("valor"), F.coalesce(blank("ds_fornecedor"), "fornecedor_razao").alias("fornecedor_cliente"), F.col("ds_documento").alias("documento"), F.col("fornecedor_cnpj").alias("cnpj_cpf"),
        F.when(F.ltrim(note) != "", F.when(F.col("ds_banco") != "", F.trim(note)).otherwise(note)).alias("descricao"), F.col("ds_conta").alias("categoria"), F.col("ds_centro").alias("centro_custo"), F.lit(PAYMENTS).alias("sistema_origem"), F.col("ds_grupo").alias("grupo"), F.col("cd_transferencia").isNotNull().alias("eh_transferencia"),
    )
    side = lambda way, kind, s: F.struct(F.lit(way).alias("way"), F.lit(kind).alias("tipo"), F.col(f"empresa_{s}").alias("cd_empresa"), F.col(f"unidade_{s}").alias("unidade"))
    said = F.concat(F.lit(f"{BETWEEN_ACCOUNTS} | "), F.coalesce(blank("banco_origem"), F.lit("origem")), F.lit(" -> "), F.coalesce(blank("banco_destino"), F.lit("destino")), F.coalesce(F.concat(F.lit(" | "), blank("ds_historico")), F.lit("")))
    day, name = F.col("data_movimento"), F.lit(BETWEEN_ACCOUNTS)
    b = moves.withColumn("s", F.explode(F.array(side("SAIDA_ORIGEM", "SAIDA", "origem"), side("ENTRADA_DESTINO", "ENTRADA", "destino")))).select(
        F.concat(F.lit(TRANSFER_ID), F.col("cd_transferencia").cast("string"), F.lit(":"), "s.way").alias("identificador_externo"), "s.cd_empresa", "s.unidade", day.alias("data_lancamento"), day.alias("dt_vencimento"), day.alias("data_pagamento"), "s.tipo", F.abs("nr_valor").cast(values.MONEY).alias("valor"),
        name.alias("fornecedor_cliente"), F.col("cd_transferencia").cast("string").alias("documento"), F.lit(None).cast("string").alias("cnpj_cpf"), said.alias("descricao"), name.alias("categoria"), F.lit(None).cast("string").alias("centro_custo"), F.lit(TRANSFERS).alias("sistema_origem"), name.alias("grupo"), F.lit(True).alias("eh_transferencia"),
    )
    return a.unionByName(b)


def import_totals(rows: DataFrame) -> DataFrame:
    """Number and total of each company and kind, and the company's gross revenue, over all ledger rows (copies of a
    payment count, as they are read)."""
    gross = (F.col("tipo") == "ENTRADA") & (F.col("sistema_origem") == PAYMENTS) & (F.col("grupo") == REVENUE) & ~F.col("eh_transferencia")
    return rows.groupBy("cd_empresa", "tipo").agg(F.count("*").alias("qtd"), F.sum("valor").cast("decimal(28,2)").alias("total"), _sum_if(gross).alias("faturamento_bruto"))


def unit_totals(rows: DataFrame) -> DataFrame:
    """Of each unit: payments, transfers, gross revenue, and what came in and went out of either origin."""
    paid, moved_, came = F.col("sistema_origem") == PAYMENTS, F.col("sistema_origem") == TRANSFERS, F.col("tipo") == "ENTRADA"
    went = F.col("tipo") == "SAIDA"
    return rows.groupBy("cd_empresa", "unidade").agg(
        F.count_if(paid).alias("pagamentos"), F.count_if(moved_).alias("transferencias"), _sum_if(paid & came & (F.col("grupo") == REVENUE)).alias("faturamento_bruto"),
        _sum_if(paid & came).alias("entradas_sem_transferencia"), _sum_if(paid & went).alias("saidas_sem_transferencia"), _sum_if(moved_ & came).alias("transferencia_entrada"), _sum_if(moved_ & went).alias("transferencia_saida"),
    )


def _realised(t: Tables, first: str, last: str) -> DataFrame:
    """Realised payments of the days with company, account group and expense flag (false where unknown)."""
    p = t["pagamentos"].where(F.col("dt_realizacao").between(first, last)).select("cd_lancamento", "nr_realizado", "nr_pagamento", "nr_previsto")
    rows = p.join(t["lancamentos"].select("cd_lancamento", "cd_empresa", "cd_conta"), "cd_lancamento").join(t["contas"].select("cd_conta", "cd_grupo"), "cd_conta", "left").join(t["contas_grupos"].select("cd_grupo", "ds_grupo", "sn_despesa"), "cd_grupo", "left")
    return rows.join(t["empresas"].select(F.col("cd_empresa").alias("empresa"), "ds_empresa"), F.col("cd_empresa") == F.col("empresa"), "left").withColumn("despesa", F.coalesce("sn_despesa", F.lit(False)))


def audit_realised(t: Tables, first: str, last: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by kind, by unit with gross revenue, what is worth something without being realised) of the detailed report."""
    rows = _realised(t, first, last)
    real = rows.where("nr_realizado <> 0")
    total = F.sum("nr_realizado").cast("decimal(28,2)")
    kind = real.groupBy(F.when(F.col("despesa"), "SAIDA").otherwise("ENTRADA").alias("tipo_movimento")).agg(F.count("*").alias("qtd"), total.alias("total"))
    gross = F.sum(F.when((F.col("ds_grupo") == REVENUE) & ~F.col("despesa"), F.col("nr_realizado"))).cast("decimal(28,2)")
    unit = real.groupBy(F.col("empresa").alias("cd_empresa"), "ds_empresa").agg(F.count("*").alias("qtd"), total.alias("total_realizado"), gross.alias("faturamento_bruto"))
    other = F.coalesce("nr_pagamento", "nr_previsto", _zero())
    rest = rows.where((F.coalesce("nr_realizado", _zero()) == 0) & (other != 0)).agg(F.count("*").alias("qtd"), F.sum(other).cast("decimal(28,2)").alias("total_fallback"))
    return kind, unit, rest


def audit_kinds(t: Tables, first: str, last: str) -> DataFrame:
    """Statistics of payment values by the entry's kind, negatives counted."""
    p = t["pagamentos"].where(F.col("dt_realizacao").between(first, last) & (due() != 0)).select("cd_lancamento", due().alias("v"))
    rows = p.join(t["lancamentos"].select("cd_lancamento", "ds_tipo"), "cd_lancamento")
    return rows.groupBy(F.coalesce("ds_tipo", F.lit("")).alias("tipo_lancamento"), "ds_tipo").agg(F.count("*").alias("qtd"), F.sum("v").cast("decimal(28,2)").alias("soma"), F.min("v").alias("menor"), F.max("v").alias("maior"), F.count_if(F.col("v") < 0).alias("negativos")).drop("ds_tipo")


def audit_not_imported(t: Tables, first: str, last: str) -> DataFrame:
    """motivo, qtd, total: what is imported from the days and what is left out, six reasons in three passes."""
    e, pays, money = t["lancamentos"], t["pagamentos"], "decimal(28,2)"
    inside = F.col("dt_realizacao").between(first, last)
    planned = F.coalesce("nr_pagamento", "nr_previsto", _zero())
    open_ = F.col("dt_realizacao").isNull() & F.col("dt_vencimento").between(first, last) & (planned != 0)
    # Names of the reasons.
    of_pays = {"pagamentos_importaveis": (inside & (due() != 0), due()), "pagamentos_no_periodo_com_valor_zero": (inside & (due() == 0), due()), "pagamentos_sem_data_realizada_com_vencimento_no_periodo": (open_, planned)}
    note = F.coalesce("nr_nota_liquido", "nr_nota_bruto", _zero())
    of_entries = {"lancamentos_sem_pagamento_com_emissao_no_periodo": (F.col("dt_emissao").between(first, last) & (note != 0), note)}
    sum_ = F.coalesce("nr_valor", _zero())
    day = moved().between(first, last)
    of_moves = {"transferencias_importaveis_geram_duas_pontas": (day & (sum_ != 0), sum_), "transferencias_no_periodo_com_valor_zero": (day & (sum_ == 0), sum_)}

    def counted(df: DataFrame, reasons: dict[str, tuple[Column, Column]]) -> DataFrame:
        one = df.agg(*(x for k, (c, v) in enumerate(reasons.values()) for x in (F.count_if(c).alias(f"n{k}"), F.sum(F.when(c, v)).cast(money).alias(f"v{k}"))))
        return one.select(F.inline(F.array(*(F.struct(F.lit(r).alias("motivo"), F.col(f"n{k}").alias("qtd"), F.col(f"v{k}").alias("total")) for k, r in enumerate(reasons)))))

    return counted(pays.join(e.select("cd_lancamento"), "cd_lancamento"), of_pays).unionByName(counted(e.join(pays.select("cd_lancamento"), "cd_lancamento", "left_anti"), of_entries)).unionByName(counted(t["bancos_transfere"], of_moves))


def audit_companies(companies: DataFrame, rows: DataFrame) -> DataFrame:
    """Every company of the ERP with what the local ledger has of it, and whether it was imported."""
    own = rows.where(F.col("sistema_origem").isin(PAYMENTS, TRANSFERS) & F.col("cd_empresa").isNotNull()).groupBy("cd_empresa")
    sums = own.agg(*(f for n, o in (("pagamentos", PAYMENTS), ("transferencias", TRANSFERS)) for f in (F.count_if(F.col("sistema_origem") == o).alias(f"{n}_qtd"), _sum_if(F.col("sistema_origem") == o).alias(f"{n}_total"))))
    got = companies.select("cd_empresa", "ds_empresa", "ds_razao", "ds_cnpj").join(sums, "cd_empresa", "left").na.fill(0, ["pagamentos_qtd", "transferencias_qtd"])
    for c in ("pagamentos_total", "transferencias_total"):
        got = got.withColumn(c, F.coalesce(c, F.lit(0).cast("decimal(28,2)")))
    return got.withColumn("status", F.when((F.col("pagamentos_qtd") > 0) | (F.col("transferencias_qtd") > 0), IMPORTED).otherwise(NOT_IMPORTED))


def open_window(df: DataFrame, paid: str, entered: str, first: str, last: str) -> DataFrame:
    """Ledger rows of the days (by payment, else entry) of a known kind that are not cancelled; a null status stays."""
    return df.where(F.coalesce(paid, entered).between(first, last) & (F.coalesce("status", F.lit("")) != "CANCELADO") & F.col("tipo").isin(*KINDS))


def year_window(df: DataFrame, day: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """(rows of a known kind within the years, one row with the number of those outside). Rows without a day or of
    another kind are in neither."""
    known = df.where(F.col("tipo").isin(*KINDS) & F.col(day).isNotNull())
    inside = F.year(day).between(first, last)
    return known.where(inside), known.agg(F.count_if(~inside).alias("fora_periodo"))
