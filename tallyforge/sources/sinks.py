"""Sinks: semicolon reports, split good and bad rows, atomic publishing, spreadsheets where a writer exists."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame


def report_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A semicolon report with a header; one file for people, many for large results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def report_files(reports: dict[str, DataFrame], root: str) -> None:
    """One semicolon report a name, with a byte order mark as spreadsheets expect it. The mark stands before the first
    column's name, so each file of a report has it; a report without rows is its header."""
    for name, df in reports.items():
        report_csv(df.withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}"), f"{root}/{name}")


def with_sidecar(df: DataFrame, meta: DataFrame, path: str) -> None:
    report_csv(df, path)
    meta.coalesce(1).write.mode("overwrite").json(f"{path}.json")


def good_and_bad(df: DataFrame, path: str, error: str = "_error") -> None:
    df.where(f"{error} is null or {error} = ''").drop(error).write.mode("overwrite").parquet(f"{path}/ok")
    df.where(f"{error} <> ''").write.mode("overwrite").parquet(f"{path}/erros")


def publish(df: DataFrame, path: str, bad: str | None = None, most_bad: int = 50) -> bool:
    """Writes beside path and renames at the end. With more than most_bad rows for which `bad` holds, the result is kept
    under .falha and the old one stays."""
    spark = df.sparkSession
    jvm, new = spark._jvm, f"{path}.em_execucao"
    df.write.mode("overwrite").parquet(new)
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    ok = not bad or spark.read.parquet(new).where(bad).count() <= most_bad
    target = path if ok else f"{path}.falha"
    old = fs_path(f"{target}.anterior")
    if fs.exists(fs_path(target)):  # a crash from here on leaves the old result beside the place of the new one
        fs.delete(old, True)
        fs.rename(fs_path(target), old)
    fs.rename(fs_path(new), fs_path(target))
    fs.delete(old, True)
    return ok


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def archive(spark, source: str, root: str, origin: str, month: str, sha256: str) -> str:  # noqa: ANN001
    """Copies a file to processados/origin/month/hash_name on any file system that Hadoop reaches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = f"{root}/processados/{origin}/{month}/{sha256[:12]}_{PurePosixPath(source).name}"
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(to)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return to


#: The most rows of a sheet, where it has a limit: the ledger-only one, whose complete CSV lies beside the workbook.
SHEET_ROWS = {"Sistema sem Banco": 20_000}
_EXCEL_ROWS = 1_048_576


def workbook(sheets: dict[str, DataFrame], path: str, most_rows: dict[str, int] | None = None) -> str:
    """A workbook with one sheet a report, streamed row by row; without openpyxl, a folder of whole CSV reports. A sheet
    in most_rows (SHEET_ROWS if None) that has more rows is cut there, with the complete CSV in {path}.csv/name and a
    sheet of notes; others go on in further sheets where Excel's rows end."""
    most_rows = SHEET_ROWS if most_rows is None else most_rows
    try:
        import openpyxl
    except ImportError:
        for name, df in sheets.items():
            report_csv(df, f"{path}/{name}")
        return "csv"
    book, notes = openpyxl.Workbook(write_only=True), []
    for name, df in sheets.items():
        most, n, sheet, part = most_rows.get(name), 0, None, 0
        for row in (df if most is None else df.limit(most + 1)).toLocalIterator():
            if n == most:
                report_csv(df, f"{path}.csv/{name}")
                notes.append(f"A aba {name} foi limitada a {most} linhas no Excel; o CSV completo fica em {path}.csv/{name}.")
                break
            if sheet is None or n % (_EXCEL_ROWS - 1) == 0:
                part += 1
                sheet = book.create_sheet(name if part == 1 else f"{name[:26]} ({part})")
                sheet.append(df.columns)
            sheet.append(list(row))
            n += 1
        if sheet is None:
            book.create_sheet(name).append(df.columns)
    if notes:
        sheet = book.create_sheet("Observacao")
        for x in notes:
            sheet.append([x])
    book.save(path)
    return "xlsx"
