"""File sources: delimited bank and ledger files, OFX, spreadsheets where a reader exists, JDBC, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values
from tallyforge.operators import etl
from tallyforge.operators.lineage import written
from tallyforge.sources import dialects

# Columns of files, prefix and origin of spreadsheet rows.
BANK_COLUMNS = ("data", "tipo_movimento", "valor", "descricao", "documento", "pagina")
BANK_META = ("banco_nome", "banco_codigo", "layout", "empresa_nome", "empresa_cnpj", "agencia", "conta", "digito")
INVENTORY_COLUMNS = ("status", "ano_detectado", "pasta_banco", "layout", "banco_nome", "banco_codigo", "empresa_nome", "empresa_cnpj", "agencia", "conta", "digito", "quantidade_transacoes", "avisos", "arquivo")
SHEET_ID, SHEET_ORIGIN = "SISTEMA-XLS:", "SISTEMA.xls"
LEDGER_REQUIRED = ("empresa_id", "tipo_movimento", "valor")
LEDGER_COLUMNS = (
    "empresa_id", "data_lancamento", "data_vencimento", "data_pagamento", "tipo_movimento", "valor", "fornecedor_cliente", "documento",
    "cnpj_cpf", "descricao", "categoria", "centro_custo", "sistema_origem", "identificador_externo", "status",
)


def bank_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon files with a header; dates day first, values with a point."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    return df.withColumns({"data_ref": values.date_any("data"), "valor": F.col("valor").try_cast(values.MONEY), "arquivo": F.input_file_name()})


def sidecar(spark: SparkSession, root: str) -> DataFrame:
    """arquivo, meta: what the JSON files of a folder tell of the data files of their names; null where they tell nothing."""
    told = ", ".join(f"{c}: string" for c in BANK_META)
    x = spark.read.schema(f"metadados struct<{told}>").option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    any_told = F.coalesce(*(F.col(f"metadados.{c}") for c in BANK_META)).isNotNull()
    return x.select(F.regexp_replace("_metadata.file_path", "\\.json$", ".csv").alias("arquivo"), F.when(any_told, F.col("metadados")).alias("meta"))


def bank_files(spark: SparkSession, root: str, defaults: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with _error) of the bank files (*.csv) of a folder, each row with its file's bank, company and account:
    from the JSON file beside it, else from the file's first row, with defaults where that is blank. A JSON file that
    tells anything is taken as a whole."""
    defaults = {"layout": "CSV_LEGADO"} | (defaults or {})
    df = dialects.table(spark, f"{root.rstrip('/')}/*.csv", (*BANK_COLUMNS, *BANK_META))
    first = df.groupBy("arquivo").agg(F.min_by(F.struct(*BANK_META), "linha").alias("first"))
    of = first.join(sidecar(spark, root), "arquivo", "left")
    own = F.struct(*(F.coalesce(F.col(f"first.{c}"), F.lit(defaults.get(c))).alias(c) for c in BANK_META))
    # One row a file, as a table: its size is known, and decides whether it is sent to all tasks.
    of = written(of.select("arquivo", F.coalesce("meta", own).alias("meta")), "meta")
    rows = df.drop("_missing", *BANK_META).join(of, "arquivo").select("*", "meta.*").drop("meta")
    day, value, page = values.date_any("data"), F.col("valor").try_cast(values.MONEY), F.col("pagina").try_cast("int")
    ok, bad = etl.valid(rows, {"data": day.isNotNull(), "tipo_movimento": F.col("tipo_movimento").isNotNull(), "valor": value.isNotNull(), "pagina": page.isNotNull()})
    return ok.withColumns({"data_ref": day, "valor": value, "pagina": page}), bad


def importable(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an inventory of statement files that can be imported."""
    return dialects.table(spark, path, INVENTORY_COLUMNS, file="inventario").where("status = 'IMPORTAVEL'").drop("_missing")


def ledger_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with _error) of ledger files, each with its own separator; arquivo and linha tell where a row
    stands. Bad rows never stop the others, nor does a file without the required columns: all its rows are rejects."""
    df = dialects.table(spark, path, LEDGER_COLUMNS, LEDGER_REQUIRED)
    dated = {c: values.date_any(c) for c in ("data_lancamento", "data_vencimento", "data_pagamento")}
    rules = {f"{c}_invalida": F.col(c).isNull() | d.isNotNull() for c, d in dated.items()}
    rules |= {"valor": values.money_ledger("valor").isNotNull(), "tipo_movimento": values.kind_ledger("tipo_movimento").isNotNull(), "status": values.status_ledger("status").isNotNull(), "empresa_id": F.col("empresa_id").try_cast("long").isNotNull()}
    whole, part = df.where("_missing = ''").drop("_missing"), df.where("_missing <> ''")
    ok, bad = etl.valid(whole, rules)
    # Asked last, of rows that are right otherwise.
    ok, undated = etl.valid(ok, {"data_lancamento_ou_data_pagamento": F.col("data_lancamento").isNotNull() | F.col("data_pagamento").isNotNull()})
    bad = bad.unionByName(undated).unionByName(part.withColumn("_error", F.concat(F.lit("colunas ausentes: "), "_missing")).drop("_missing"))
    ok = ok.withColumns({**dated, "valor": values.money_ledger("valor"), "tipo": values.kind_ledger("tipo_movimento"), "status": values.status_ledger("status"), "empresa_id": F.col("empresa_id").cast("long")})
    return ok.withColumn("data_ref", F.coalesce("data_pagamento", "data_lancamento")), bad


def ofx(files: DataFrame) -> DataFrame:
    """Movements of OFX files given as (path, content binary): UTF-8 where it is valid, else Windows-1252."""
    # Latin 1 differs from Windows-1252 in these characters only.
    high = [(chr(k), bytes([k]).decode("cp1252")) for k in range(0x80, 0xA0) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    windows = F.translate(F.decode("content", "ISO-8859-1"), "".join(a for a, _ in high), "".join(b for _, b in high))
    body = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), windows)
    block = F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|\z)"), F.lit(1)))
    rows = files.select("path", block.alias("b"))
    tag = lambda t: F.trim(F.regexp_extract("b", rf"(?i)<{t}>([^<\r\n]*)", 1))
    out = rows.select("path", values.kind_ofx(tag("TRNTYPE")).alias("tipo"), values.date_ofx(tag("DTPOSTED")).alias("data_ref"), values.money_ofx(tag("TRNAMT")).alias("valor"), tag("FITID").alias("identificador"), tag("CHECKNUM").alias("documento"), tag("MEMO").alias("descricao"))
    return out.withColumn("registro", values.record_kind("descricao"))


def ofx_files(spark: SparkSession, path: str) -> DataFrame:
    return ofx(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[oO][fF][xX]").load(path).select("path", "content"))


def ledger_sheet(files: DataFrame) -> DataFrame:
    """Spreadsheet rows by position, for (path, content binary); needs openpyxl on the executors."""
    names = ["data_realizacao", "valor_realizado", "nf_bruto", "banco", "forma_pagamento", "empresa_unidade", "centro_custo", "conta", "grupo", "favorecido", "descricao", "razao_social", "cnpj_cpf"]
    schema = "path string, row_no int, " + ", ".join(f"{n} string" for n in names)

    def run(batches):  # noqa: ANN001, ANN202
        import io

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x = pd.read_excel(io.BytesIO(content), sheet_name="SISTEMA", dtype=str).iloc[:, : len(names)]
                x.columns = names[: x.shape[1]]
                yield x.assign(path=path, row_no=range(2, len(x) + 2))[["path", "row_no", *names]]

    return files.mapInPandas(run, schema)


def sheet_ledger(rows: DataFrame) -> DataFrame:
    """Ledger rows of spreadsheet rows (sha256 of the file, row_no, the columns of ledger_sheet): the sign of a value tells
    its kind, rows of 0 are left out. An unreadable value or day is null and its row left out too."""
    value, day = F.expr("try_cast(valor_realizado as decimal(18,2))"), F.expr("try_cast(substring(data_realizacao, 1, 10) as date)")
    text = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias
    x = rows.withColumns({"_value": value, "_day": day}).where("_value <> 0 and _day is not null")
    return x.select(
        F.concat(F.lit(SHEET_ID), F.substring("sha256", 1, 16), F.lit(":"), F.when(F.col("row_no") < 10_000, F.lpad(F.col("row_no").cast("string"), 4, "0")).otherwise(F.col("row_no").cast("string"))).alias("identificador_externo"),
        F.col("_day").alias("data_lancamento"), F.col("_day").alias("data_pagamento"), F.when(F.col("_value") > 0, "ENTRADA").otherwise("SAIDA").alias("tipo"), F.abs("_value").cast(values.MONEY).alias("valor"), text("favorecido")("fornecedor_cliente"),
        text("cnpj_cpf")("cnpj_cpf"), text("descricao")("descricao"), text("conta")("categoria"), text("centro_custo")("centro_custo"), F.lit(SHEET_ORIGIN).alias("sistema_origem"), F.lit("ABERTO").alias("status"),
    )


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A relational table; with a numeric column it is read in ranges by many tasks."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...], include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), first_year: int | None = None) -> DataFrame:
    """path, length, sha256 of files below root, each path once whatever its case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    up = F.upper("path")
    df = df.where(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin([e.lower() for e in extensions]))
    for word in include:
        df = df.where(up.contains(word.upper()))
    for word in exclude:
        df = df.where(~up.contains(word.upper()))
    if first_year:
        df = df.where(values.year_in_path("path") >= first_year)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256")).groupBy(F.lower("path").alias("_k")).agg(F.min_by(F.struct("path", "length", "sha256"), "path").alias("f")).select("f.*")


def pending(files: DataFrame, log: DataFrame, again: bool = False) -> DataFrame:
    """Files that the log does not have as done."""
    done = log.where("status_importacao = 'OK'").select(F.lower("arquivo").alias("_k"))
    return files if again else files.join(done, F.lower("path") == F.col("_k"), "left_anti")


def catalog(spark: SparkSession, words: tuple[str, ...] = ()) -> DataFrame:
    """table, column, type of the session's catalog, for names that hold one of the words."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name) if not words or any(w in t.name.lower() for w in words)]
    return spark.createDataFrame(rows, "tabela string, coluna string, tipo string")
