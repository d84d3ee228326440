"""Money, dates, kinds and keys as column expressions. Each source has its own money format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Report columns of days and of numbers.
DATE_COLUMNS = ("data", "banco_data", "sistema_data")
NUMBER_COLUMNS = ("valor", "banco_valor", "sistema_valor", "diferenca_valor", "score", "quantidade")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: str | Column) -> Column:
    """Whole cents, cut towards zero."""
    return (_col(c) * 100).cast("long")


def money_statement(c: str | Column) -> Column:
    """'R$ 1.234,56' or '1234.56': points are thousands only if there is a comma; null if unreadable."""
    t = F.regexp_replace(_col(c), "R\\$|\\s", "")
    return F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t).try_cast(MONEY)


def money_ledger(c: str | Column) -> Column:
    """Every point is a thousands mark, even without a comma; the size only. Blank or unreadable is null."""
    t = F.regexp_replace(F.trim(_col(c)), "R\\$|\\s", "")
    return F.abs(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(MONEY))


def money_ofx(c: str | Column) -> Column:
    """Comma or point before the cents; unreadable counts as 0."""
    return F.coalesce(F.abs(F.replace(F.trim(_col(c)), F.lit(","), F.lit(".")).try_cast(MONEY)), F.lit(0).cast(MONEY))


def date_ofx(c: str | Column) -> Column:
    return F.try_to_date(F.substring(_col(c), 1, 8), "yyyyMMdd")


def date_any(c: str | Column) -> Column:
    """Year first, day first with slashes, or day first with dashes; else null."""
    t = F.trim(_col(c))
    return F.coalesce(*(F.try_to_date(F.when(t.rlike(p), t), f) for p, f in (("^\\d{4}-\\d{1,2}-\\d{1,2}$", "y-M-d"), ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/y"), ("^\\d{1,2}-\\d{1,2}-\\d{4}$", "d-M-y"))))


def kind_ofx(c: str | Column) -> Column:
    """CREDIT and DEBIT only; all others are null and rejected."""
    t = F.upper(F.trim(_col(c)))
    return F.when(t == "CREDIT", "ENTRADA").when(t == "DEBIT", "SAIDA")


def kind_ledger(c: str | Column) -> Column:
    """Null for what is no known kind: such rows are rejected."""
    # Synonyms of the two kinds of movement.
    t = F.upper(F.trim(_col(c)))
    return F.when(t.isin("ENTRADA", "RECEITA", "CREDITO", "CREDIT"), "ENTRADA").when(t.isin("SAIDA", "DESPESA", "DEBITO", "DEBIT"), "SAIDA")


def status_ledger(c: str | Column) -> Column:
    """Blank is ABERTO; null for what is no known status."""
    t = F.upper(F.trim(F.coalesce(_col(c), F.lit(""))))
    return F.when(t == "", "ABERTO").when(t.isin("ABERTO", "CONCILIADO", "PENDENTE", "CANCELADO"), t)


def kind_erp(is_expense: str | Column, ds_tipo: str | Column) -> Column:
    """By the expense flag; without one, F and U come in and all else goes out."""
    e = _col(is_expense)
    return F.when(e.isNull(), F.when(_col(ds_tipo).isin("F", "U"), "ENTRADA").otherwise("SAIDA")).when(e, "SAIDA").otherwise("ENTRADA")


def record_kind(memo: str | Column) -> Column:
    t = F.upper(F.coalesce(_col(memo), F.lit("")))
    return F.when(t.contains("SALDO ANTERIOR"), "SALDO_ANTERIOR").when(t.contains("SALDO TOTAL DISPONIVEL DIA") | t.contains("SALDO TOTAL DISPONÍVEL DIA"), "SALDO_DIA").otherwise("MOVIMENTACAO")


def document_in(c: str | Column) -> Column:
    """The first company number, person number or run of 11 to 14 digits in a text; '' if none."""
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|\b\d{11,14}\b)", 1)


def account_parts(c: str | Column) -> tuple[Column, Column]:
    """(account, check digit): points dropped, split at the last dash."""
    t = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("."), F.lit(""))
    return F.when(t.contains("-"), F.regexp_extract(t, "^(.*)-[^-]*$", 1)).otherwise(t), F.regexp_extract(t, "-([^-]*)$", 1)


def company_number(c: str | Column) -> Column:
    """14 digits as NN.NNN.NNN/NNNN-NN; all else as it is."""
    d = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^0-9]", "")
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise(_col(c))


def surrogate_company(*parts: str | Column) -> Column:
    """Key of a company without a number, from its name, bank and account."""
    key = F.concat_ws("|", *(F.when(_col(p) != "", _col(p)) for p in parts))
    return F.concat(F.lit("SEM-CNPJ:"), F.substring(F.sha1(key.cast("binary")), 1, 11))


def brl(c: str | Column) -> Column:
    """1234.5 as 'R$ 1.234,50'."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(_col(c).cast(MONEY), 2), ",.", ".,"))


def year_in_path(c: str | Column) -> Column:
    """A path part that is a year 20dd, else the first such run of digits; null if none."""
    part, anywhere = F.regexp_extract(_col(c), r"(?:^|[/\\])(20\d{2})(?:[/\\]|$)", 1), F.regexp_extract(_col(c), r"(20\d{2})", 1)
    return F.when(part != "", part).when(anywhere != "", anywhere).try_cast("int")


def extraction_status(layout: str | Column, rows: str | Column, error: str | Column) -> Column:
    """State of a statement file by its layout, number of rows and reading error."""
    l = _col(layout)
    return (
        F.when(_col(error).isNotNull(), "ERRO_LEITURA").when(l == "CLINUX_EXTRATO_BANCO", "RELATORIO_CLINUX_NAO_IMPORTAR").when(_col(rows) > 0, "IMPORTAVEL")
        .when(l == "PDF_SEM_TEXTO_EXTRAIVEL", "PRECISA_OCR").when(l == "NAO_SUPORTADO", "NAO_SUPORTADO").otherwise("SEM_MOVIMENTO_CONCILIAVEL")
    )


def network_error(status: str | Column, message: str | Column) -> Column:
    # Parts of messages that mean the share was not reachable.
    t = F.lower(F.coalesce(_col(message), F.lit("")))
    parts = ("arquivo nao encontrado", "no such file or directory", "cannot find path", "network")
    out = F.lit(False)
    for p in parts:
        out = out | t.contains(p)
    return (_col(status) == "ERRO_LEITURA") & out


def report_cell(header: str, c: str | Column) -> Column:
    """A cell of a text report by its column's name, as struct(day, number, text): one field is set, none where the cell
    is blank. Line ends become spaces; what is no day or number stays text."""
    t = F.trim(F.replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" ")))
    h = header.lower()
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")) if h in DATE_COLUMNS else F.lit(None).cast("date")
    number = t.try_cast("decimal(38,6)") if h in NUMBER_COLUMNS else F.lit(None).cast("decimal(38,6)")
    return F.struct(day.alias("day"), number.alias("number"), F.when((t != "") & day.isNull() & number.isNull(), t).alias("text"))
