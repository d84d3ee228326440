"""Loading facts: building ledger rows, dedup keys, idempotent appends, upserts by rewrite, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text, values

# Prefixes of external ids.
PAYMENT_ID, TRANSFER_ID = "CLINUX:PAGAMENTO:", "CLINUX:TRANSFERENCIA:"


def ledger_from_payments(payments: DataFrame) -> DataFrame:
    """ERP payments as ledger rows: values that are not 0, kind by the expense flag, other columns as JSON."""
    value = F.coalesce("nr_realizado", "nr_pagamento", "nr_previsto", F.lit(0)).cast(values.MONEY)
    rest = [c for c in payments.columns if c not in ("nr_realizado", "nr_pagamento", "nr_previsto", "dt_realizacao", "ds_historico", "ds_documento")]
    return payments.where(value != 0).select(
        F.concat(F.lit(PAYMENT_ID), F.col("cd_pagamento").cast("string")).alias("identificador_externo"), F.col("dt_realizacao").cast("date").alias("data_ref"), values.kind_erp("sn_despesa", "ds_tipo").alias("tipo"),
        F.abs(value).alias("valor"), F.trim(F.concat_ws(" - ", *(F.when(F.trim(c) != "", F.trim(c)) for c in (F.col("ds_documento"), F.col("ds_historico"))))).alias("descricao"), F.to_json(F.struct(*rest)).alias("metadados"),
    )


def ledger_from_transfers(transfers: DataFrame) -> DataFrame:
    """Each transfer as two rows: out at the source, in at the destination."""
    side = lambda tipo, bank: F.struct(F.lit(tipo).alias("tipo"), F.col(bank).alias("banco"))
    out = transfers.where("nr_valor <> 0").withColumn("s", F.explode(F.array(side("SAIDA", "banco_origem"), side("ENTRADA", "banco_destino"))))
    return out.select(F.concat_ws(":", F.lit(TRANSFER_ID.rstrip(":")), F.col("cd_transferencia").cast("string"), F.when(F.col("s.tipo") == "SAIDA", "SAIDA_ORIGEM").otherwise("ENTRADA_DESTINO")).alias("identificador_externo"), "data_ref", "s.tipo", "s.banco", F.abs(F.col("nr_valor")).cast(values.MONEY).alias("valor"), F.col("cd_transferencia").cast("string").alias("documento"))


def dedup_key(df: DataFrame, file: str, order: list[str], account: list[str]) -> DataFrame:
    """Adds dedup_key. Genuine repeats in one file differ by their number; overlapping files give equal keys."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in account] + [F.date_format("data", "yyyy-MM-dd"), F.col("tipo"), values.cents("valor").cast("string"), text.normalize("descricao"), F.coalesce("documento", F.lit(""))]
    base = df.withColumn("_base", F.concat_ws("|", *parts))
    n = F.row_number().over(Window.partitionBy(file, "_base").orderBy(*order))
    return base.withColumn("dedup_key", F.sha2(F.concat_ws("|", "_base", n.cast("string")), 256)).drop("_base")


def overlapping_once(df: DataFrame) -> DataFrame:
    """One row of each dedup_key: the one of the smallest file."""
    return df.groupBy("dedup_key").agg(F.min(F.struct(*[c for c in df.columns if c != "dedup_key"])).alias("r")).select("dedup_key", "r.*")


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is neither in existing nor twice in new; a null key is always new."""
    has = reduce(Column.__and__, (F.col(k).isNotNull() for k in key))
    known = new.where(has).dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")
    return known.select(*new.columns).unionByName(new.where(~has))


def append_by_content(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if absent by company, kind, value, document and date, where a null document equals ''."""
    key = lambda df: df.withColumn("_doc", F.coalesce("documento", F.lit("")))
    on = ["empresa_id", "tipo", "valor", "_doc", "data_ref"]
    return key(new).dropDuplicates(on).join(key(existing).select(*on).distinct(), on, "left_anti").select(*new.columns)


def _without(x: Column, y: Column) -> Column:
    """The entries of map x whose key is not in map y."""
    return F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], merged: str | None = None) -> DataFrame:
    """Full rewrite: new values win where not null; the JSON object column `merged` takes both, new keys winning."""
    a, b = existing.alias("a"), new.alias("b")
    got = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    cols = []
    for c in existing.columns:
        if c == merged:
            kind = "map<string,string>"
            x, y = (F.coalesce(F.from_json(f"{s}.{c}", kind), F.create_map().cast(kind)) for s in "ab")
            keep = _without(x, y)
            cols.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(keep, y))))).alias(c))
        else:
            cols.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
    return got.select(*cols)


def replace_origin(links: DataFrame, heads: DataFrame, facts: DataFrame, files: DataFrame, origin: str) -> tuple[DataFrame, ...]:
    """The four tables without what came from one origin: facts, their links, heads left without links, files."""
    dead = facts.where(F.col("sistema_origem") == origin).select(F.col("id").alias("lancamento_id"))
    live = links.join(dead, "lancamento_id", "left_anti")
    gone = links.select("conciliacao_id").distinct().join(live.select("conciliacao_id").distinct(), "conciliacao_id", "left_anti")
    return live, heads.join(gone, heads["id"] == gone["conciliacao_id"], "left_anti"), facts.where(~F.col("sistema_origem").eqNullSafe(F.lit(origin))), files.where(~F.col("origem").eqNullSafe(F.lit(origin)))


def retain(df: DataFrame, date: str, first: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows to back up and delete): before the first day kept."""
    old = F.coalesce(F.col(date) < F.lit(first).cast("date"), F.lit(False))
    return df.where(~old), df.where(old)


def retention_totals(df: DataFrame, date: str, first: str) -> DataFrame:
    """Dry run: what would stay and go."""
    old = F.col(date) < F.lit(first).cast("date")
    return df.agg(*(f(F.when(old if w else ~old, F.col("valor"))).alias(f"{n}_{'antes' if w else 'depois'}") for w in (True, False) for n, f in (("qtd", F.count), ("total", F.sum))))


def high_water_mark(ids: Column, prefix: str) -> Column:
    """The largest number after prefix among well-formed ids."""
    return F.max(F.regexp_extract(ids, f"^{prefix}(\\d+)$", 1).try_cast("long"))


def valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that hold all rules, others with the names of the rules they break in _error)."""
    broken = F.concat_ws(",", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))
    out = df.withColumn("_error", broken)
    return out.where("_error = ''").drop("_error"), out.where("_error <> ''")


def run_log(spark_df: DataFrame, params: dict[str, str]) -> DataFrame:
    """One row that records a run: its parameters and the totals in spark_df as JSON."""
    totals = spark_df.agg(F.to_json(F.collect_list(F.struct(*spark_df.columns))).alias("totais"))
    kv = F.to_json(F.create_map(*(F.lit(x) for p in sorted(params.items()) for x in p))) if params else F.lit("{}")
    return totals.select(kv.alias("parametros"), "totais", F.lit("PROCESSADO").alias("status"))
