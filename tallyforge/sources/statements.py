"""Bank statements as line tables: layout detection, headers and rows, by a table of layouts.

Input is (file, page, line_no, line), which any text extraction gives. Layouts are data: what begins and ends the
table, which lines are rows, which are skipped, which continue a description, and where the header tells the bank,
company and account. The table of layouts (fifteen rows) is broadcast; its patterns are columns. What a line is
follows from itself and from windows over its file: whether the table is open, the last date, whether an item or a row
is open. Lines then fall into islands, one a row: the lines held before it, the row, the lines that continue it.
Null lines are empty; lines of equal page and number keep no order of their own; a file without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text, values

LINES = "file string, page int, line_no int, line string"
ROWS = "file string, layout string, page int, row_no int, data string, tipo string, valor decimal(18,2), descricao string, documento string"

# Portuguese month abbreviations.
MONTHS = {"jan": "01", "fev": "02", "mar": "03", "abr": "04", "mai": "05", "jun": "06", "jul": "07", "ago": "08", "set": "09", "out": "10", "nov": "11", "dez": "12"}

_V = r"[\d.]+,\d{2}"
_D = r"\d{2}/\d{2}/\d{4}"


@dataclass
class Layout:
    """rows: patterns with groups date, desc, value, and doc, sign, kind or neg where they occur. Upper-case patterns
    (start, stop, skip, no_row) are matched on accent-free upper-case lines. item, item_doc and item_value: a row over
    several lines, that is, its date (group 2: money out), its document and description, its value; the lines held
    before are the beginning of its description."""

    rows: list[str]
    start: str = ""
    stop: str = ""
    skip: str = ""
    no_row: str = r"^SALDO"
    date_line: str = ""
    join: str = ""
    join_tail: str = ""
    pending: str = ""
    doc_line: str = ""
    item: str = ""
    item_doc: str = ""
    item_value: str = ""
    year: str = ""
    any_year: str = ""
    doc_in_desc: str = ""
    flags: int = 0


# Line formats of each layout.
LAYOUTS: dict[str, Layout] = {
    "CORA": Layout(rows=[rf"^(?P<desc>.+?)\s(?P<sign>[+-])\sR\$\s(?P<value>{_V})$"], date_line=rf"^({_D})\s+Saldo do dia\s+R\$", no_row=r"(?!)"),
    "CLINUX_EXTRATO_BANCO": Layout(rows=[rf"^(?P<date>{_D})\s+(?P<desc>.+?)\s+(?P<value>-?{_V})$"], skip=r"SALDO INICIAL", no_row=r"^[*\s]*$"),
    "BRADESCO_NET_EMPRESA": Layout(
        rows=[rf"^(?P<date>{_D})\s+(?P<doc>\S+)\s+(?P<value>-?{_V})\s+(-?{_V})$", rf"^(?P<doc>\S+)\s+(?P<value>-?{_V})\s+(-?{_V})$"],
        start=r"DATA LANCAMENTO.*SALDO", skip=r"^(SALDO ANTERIOR|SALDO|DATA LAN|EXTRATO|BANCO BRADESCO)", join=r"^(REM|DEST|PAGADOR|FAV|BENEF):", pending=rf"^(?!.*{_V})",
    ),
    "CAIXA_GERENCIADOR": Layout(rows=[rf"^(?P<date>{_D})\s+(?P<doc>\S+)\s+(?P<desc>.+?)\s+(?P<value>{_V})\s+(?P<kind>[CD])\s+{_V}\s+[CD]$", rf"^(?P<date>{_D})\s+{_D}\s+(?P<doc>\S+)\s+(?P<desc>.+?)\s+(?P<value>-?[\d.]+\.\d{{2}})\s+-?[\d.]+\.\d{{2}}$"]),
    "BANCO_DO_BRASIL_CONTA_CORRENTE": Layout(rows=[rf"^(?P<date>{_D})\s+\d{{4}}\s+\d+\s+\d+\s+(?P<desc>.+?)\s+(?P<value>{_V})\s+(?P<kind>[CD])(?:\s+{_V}\s+[CD])?$"], no_row=r"SALDO ANTERIOR", join_tail=r"^\d{2}/\d{2}\s+\d{2}:\d{2}\s+(.+)$"),
    "BASA_AMAZONIA_ONLINE": Layout(
        rows=[rf"^(?P<date>{_D})\s+(?P<doc>\S+)\s*(?P<desc>.*?)\s*R\$\s*(?P<value>{_V})\s*(?P<tail>.*)$"], start=r"MOVIMENTACOES", stop=r"^(SALDOS|SALDO ATUAL|= SALDO DISPONIVEL)$",
        skip=r"SALDO DO DIA|SALDO ATUAL|SALDO ANTERIOR|^(DETALHES DA|DATA DOCUMENTO HISTORICO VALOR SALDO|TRANSACAO)$", no_row=r"(?!)", join=r".", pending=r".",
    ),
    "SICOOB_SISBR": Layout(rows=[rf"^(?P<date>\d{{2}}/\d{{2}})\s+(?P<desc>.+?)\s+(?P<value>{_V})(?P<kind>[CD])$"], year=r"PER[IÍ]ODO:\s*\d{2}/\d{2}/(\d{4})", doc_line=r"^DOC\.:\s*(.*)$", join=rf"^(?!.*{_V}[CD]$)"),
    "SAFRA_EXTRATO_MOVIMENTACAO": Layout(
        rows=[rf"^(?P<date>\d{{2}}/\d{{2}})\s+(?P<desc>.+?)\s+(?P<value>-?{_V})$"], start=r"LANCAMENTOS REALIZADOS", skip=r"^(DATA LANCAMENTO|BANCO SAFRA)", year=r"Per[ií]odo de \d{2}/\d{2}/(\d{4})", join=r"^[\d.\s-]{8,}$",
    ),
    "STONE_CONTA_CORRENTE": Layout(rows=[rf"^(?P<date>{_D})\s+(?P<kind>Cr[eé]dito|D[eé]bito)\s+(?P<value>{_V})\s+(-?{_V})$"], skip=r"^(DATA TIPO|INFORMACOES DO COMPROVANTE|CODIGO DE AUTENTICACAO)", join=r"\|", pending=rf"^(?!.*({_D}|{_V}))", flags=re.I),
    "BNB_CONTA_CORRENTE": Layout(
        rows=[rf"^(?P<date>{_D})\s+(?P<doc>\d+)\s+(?P<value>-?\s*{_V})\s+(-?\s*{_V})$", rf"^(?P<date>{_D})\s+(?P<desc>.+?)\s+(?P<doc>\d+)\s+(?P<value>-?\s*{_V})\s+(-?\s*{_V})$"],
        start=r"DATA HISTORICO DOCUMENTO VALOR", stop=r"^DETALHAMENTO DO SALDO", pending=rf"^(?!{_D}|::)",
    ),
    "UNICRED_CONTA_CORRENTE": Layout(rows=[rf"^(?P<date>{_D})\s+(?P<doc>\S+)\s+(?P<desc>.+?)\s+(?P<value>-?{_V})\s+(-?{_V})$"]),
    "UNICRED_CONTA_CORRENTE_NOVO": Layout(
        rows=[rf"^(?P<date>{_D})\s+(?P<neg>-?\s*)?R\$\s*(?P<value>{_V})\s+R\$\s*{_V}$", rf"^(?P<date>{_D})\s+(?P<desc>.+?)\s+(?P<neg>-?\s*)?R\$\s*(?P<value>{_V})\s+R\$\s*{_V}$"],
        start=r"DATA LANCAMENTOS VALOR", stop=r"^CENTRAL DE RELACIONAMENTO", skip=r"^(SALDO|LIMITE)", pending=rf"^(?!{_D})", doc_in_desc=r"Doc\.?:\s*([^)]+)",
    ),
    "UNIPRIME_CONTA_CORRENTE": Layout(rows=[rf"^(?P<date>{_D})\s+(?P<desc>.+?)\s+(?P<value>{_V})\s+(?P<sign>[+-])\s+[-\d.,]+(?:\s+[+-])?$"], doc_in_desc=r"^(\d+)\s"),
    "ITAU_CONTA_CORRENTE": Layout(
        rows=[rf"^(?P<date>{_D})\s+(?P<desc>.+?)\s+(?P<value>-?{_V})$", rf"^(?P<date>\d{{2}}\s*/\s*[a-zç]{{3}})\s+(?P<desc>.+?)\s+(?P<value>-?{_V})$"],
        start=r"DATA LAN[CG]AMENTOS.*VALOR", stop=r"^SALDO DA CONTA CORRENTE", no_row=r"^(SALDO ANTERIOR|SALDO DO DIA|SALDO TOTAL|SALDO DISPON)", year=r"lan[çc]amentos(?:\s+do)?\s+per[ií]odo:\s*\d{2}/\d{2}/(\d{4})", any_year=r"\b(20\d{2})\b",
        pending=rf"^(?!.*{_V}$)", flags=re.I,
    ),
    "CAIXA_EXTRATO_NOVO": Layout(
        rows=[rf"^(?P<date>{_D})\s+(?P<doc>\S+)\s+(?P<desc>.+?)\s+(?P<neg>-?\s*)?R\$\s*(?P<value>{_V})\s+R\$\s*{_V}\s*[CD]?$"], item=rf"^({_D})(\s+-)?$", item_doc=rf"^(\d{{6}})\s+(.*?)\s*(?:R\$\s*{_V}\s*[CD]?)?$", item_value=rf"R\$\s*({_V})$",
        start=r"DOCUMENTO HISTORICO|DATA EFETIVA", skip=r"SALDO DIA|SALDO ANTERIOR", no_row=r"(?!)", pending=rf"^(?!{_D}|\d{{2}}/\d{{2}}\s+\d{{2}}:\d{{2}}|.*R\$)",
    ),
}
NO_MOVEMENT = "DEMONSTRATIVO_SEM_MOVIMENTO_TRANSACIONAL"


_CNPJ = r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}"

# Name and number of each layout's bank.
BANKS = {
    "CORA": ("BANCO CORA", None), "BRADESCO_NET_EMPRESA": ("BANCO BRADESCO", "237"), "CAIXA_GERENCIADOR": ("CAIXA ECONOMICA FEDERAL", "104"), "BANCO_DO_BRASIL_CONTA_CORRENTE": ("BANCO DO BRASIL", "001"),
    "BASA_AMAZONIA_ONLINE": ("BANCO DA AMAZONIA", "003"), "SICOOB_SISBR": ("SICOOB", "756"), "SAFRA_EXTRATO_MOVIMENTACAO": ("BANCO SAFRA", "422"), "STONE_CONTA_CORRENTE": ("STONE", None),
    "BNB_CONTA_CORRENTE": ("BANCO DO NORDESTE", "004"), "UNICRED_CONTA_CORRENTE": ("BANCO UNICRED", "136"), "UNICRED_CONTA_CORRENTE_NOVO": ("BANCO UNICRED", "136"), "UNIPRIME_CONTA_CORRENTE": ("BANCO UNIPRIME", "099"),
    "ITAU_CONTA_CORRENTE": ("BANCO ITAU", "341"), "CAIXA_EXTRATO_NOVO": ("CAIXA ECONOMICA FEDERAL", "104"), "UNICRED_RENTABILIDADE": ("BANCO UNICRED", "136"), "ITAU_DEMONSTRATIVO_APLICACAO": ("BANCO ITAU", "341"),
    "CAIXA_DEMONSTRATIVO_APLICACAO": ("CAIXA ECONOMICA FEDERAL", "104"), "BNB_CONSOLIDADO_INVESTIMENTO": ("BANCO DO NORDESTE", "004"),
}
UNKNOWN_BANK = "BANCO NAO IDENTIFICADO"
# Header formats of each layout; the fields are those of the groups, the first pattern that matches wins.
# full_account is an account with its digit, short_agency an agency without leading zeros.
_NAME, _TAX, _AG, _ACC, _FULL, _SHORT = "empresa_nome", "empresa_cnpj", "agencia", "conta", "full_account", "short_agency"
HEADERS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "CORA": [(r"^(\S.*)", (_NAME,)), (rf"CNPJ\s+({_CNPJ})", (_TAX,)), (r"(?i)Ag[êe]ncia:\s*(\d+)\s*-\s*Conta:\s*([\d.]+)-?(\d+)?", (_AG, _ACC, "digito"))],
    "CLINUX_EXTRATO_BANCO": [(r"^(\S.*)", (_NAME,)), (rf"({_CNPJ})", (_TAX,)), (r"(?i)BANCO:\s*(.+?)\s+-\s+PERIODO:", ("banco_nome",))],
    "BRADESCO_NET_EMPRESA": [(rf"^(.+?)\s+\|\s+CNPJ:\s*({_CNPJ})", (_NAME, _TAX)), (r"(\d{3,5})\s+\|\s+([\d.]+-\d)", (_SHORT, _FULL))],
    "CAIXA_GERENCIADOR": [(r"Cliente:\s*(.+)", (_NAME,)), (r"Conta:\s*(\d+)\s*\|\s*\d+\s*\|\s*([\d.]+-\d)", (_AG, _FULL)), (r"(?i)Ag[êe]ncia:\s*(\d+)\s*/\s*Produto:\s*\d+\s*/\s*Conta:\s*([\d.]+-\d)", (_AG, _FULL))],
    "BANCO_DO_BRASIL_CONTA_CORRENTE": [(r"Ag[êe]ncia\s+([\d-]+)", (_AG,)), (r"Conta corrente\s+([\d.-]+)\s*(.*)", (_FULL, _NAME))],
    "BASA_AMAZONIA_ONLINE": [(r"Ag[êe]ncia:\s*(\d+)", (_AG,)), (r"Conta:\s*([\d.]+-\d)", (_FULL,)), (r"Nome do Cliente:\s*(.+)", (_NAME,))],
    "SICOOB_SISBR": [(r"CONTA:\s*([\d.]+-\d)\s*/\s*(.+)", (_FULL, _NAME))],
    "SAFRA_EXTRATO_MOVIMENTACAO": [(r"Extrato de Movimenta[çc][aã]o\s+(.+)", (_NAME,)), (r"(?i)CNPJ:\s*([\d./-]+)\s*\|\s*AG:\s*(\d+)\s*\|\s*CONTA:\s*([\d.]+-\d)", (_TAX, _AG, _FULL))],
    "STONE_CONTA_CORRENTE": [(rf"(?is)Titular\s+(.+?)\s+Institui[çc][aã]o\s+Stone.+?Documento\s+({_CNPJ})\s+Ag[êe]ncia\s+(\d+)", (_NAME, _TAX, _AG)), (r"Conta\s+([\d.]+-\d)", (_FULL,))],
    "BNB_CONTA_CORRENTE": [(r"(?i)Titular:\s*(.+)", (_NAME,)), (r"(?i)Ag[êe]ncia/Conta Corrente:\s*(\d+)\s*-\s*[^/]+/([\d.]+-\d)", (_AG, _FULL))],
    "UNICRED_CONTA_CORRENTE": [(r"(?i)CONTA:\s*(\d+)", (_ACC,)), (r"(?is)CLIENTE:\s*(.+?)(?:\n|USU[ÁA]RIO)", (_NAME,))],
    "UNICRED_CONTA_CORRENTE_NOVO": [(r"(?i)Coop:\s*\d+\s*-\s*AG:\s*(\d+)\s*-\s*Conta:\s*(\d+)", (_AG, _ACC)), (r"(?is)Extrato\s+(.+?)\s+Per[ií]odo", (_NAME,))],
    "UNIPRIME_CONTA_CORRENTE": [(r"(?i)Conta Corrente:\s*([\d.]+-\d)", (_FULL,)), (r"(?i)Ag[êe]ncia:\s*(\d+)", (_AG,)), (r"(?i)Cooperado:\s*(.+?)\s+Usu[áa]rio:", (_NAME,))],
    "ITAU_CONTA_CORRENTE": [
        (rf"(?im)^(.+?)\s+ag[êe]ncia\s+conta corrente\s+({_CNPJ})\s+(\d+)\s+([\d.]+-\d)", (_NAME, _TAX, _AG, _FULL)), (rf"(?im)^(.+?)\s+CNPJ\s+Ag[êe]ncia\s+(\d+)\s+Conta\s+([\d.]+-\d)\s*\n({_CNPJ})", (_NAME, _AG, _FULL, _TAX)),
        (rf"({_CNPJ})\s+(\d{{3,5}})\s+([\d.]+-\d)", (_TAX, _AG, _FULL)),
    ],
    "CAIXA_EXTRATO_NOVO": [(r"^(\S.*)", (_NAME,)), (rf"CNPJ:\s*({_CNPJ})", (_TAX,)), (r"(?i)Ag[êe]ncia:\s*(\d+)\s+Conta:\s*([\d.]+-\d)", (_SHORT, _FULL))],
}
# Warnings.
NO_ROWS_WARNING = "PDF identificado como demonstrativo/resumo sem lancamentos transacionais para conciliacao bancaria."
ERP_WARNING = "Este PDF parece ser relatorio do Clinux/Genesis, nao extrato oficial do banco."
UNSUPPORTED_WARNING = "Layout ainda nao suportado: "
#: A header entry may run over this many lines.
SPAN = 6


def detect(t: Callable[[str], Column], name: Column, any_text: Column, raw: Callable[[str], Column]) -> Column:
    """Layout by ordered tests on the accent-free upper-case text (t: does it hold a mark?) and file name, and on the
    upper-case raw text."""
    n = name.contains
    # Marks of each layout, in the order in which they are tested.
    return (
        F.when(t("EXTRATO BANCO USUARIO") | t("CLINUX - SISTEMA DE GESTAO"), "CLINUX_EXTRATO_BANCO").when(t("AGENCIA:") & t("CONTA:") & t("CORA"), "CORA")
        .when(t("GEREN_CIADOR CAI_XA") | (t("EXTRATO POR PERIODO") & (t("CAIXA") | t("CONTA:"))), "CAIXA_GERENCIADOR").when(t("EXTRATO NO PERIODO") & n("CAIXA"), "CAIXA_EXTRATO_NOVO")
        .when((t("CONSULTAS - EXTRATO DE CONTA CORRENTE") & (t("BANCO DO BRASIL") | t("CONTA CORRENTE"))) | n("BANCO DO BRASIL") | name.rlike(r"\bBB\b"), "BANCO_DO_BRASIL_CONTA_CORRENTE")
        .when((t("EXTRATO DE CONTA CORRENTE - NO PERIODO") & n("BANCO DO NORDESTE")) | (t("AGENCIA/CONTA CORRENTE") & t("DETALHAMENTO DO EXTRATO")), "BNB_CONTA_CORRENTE")
        .when(t("EXTRATO DE CONTA CORRENTE PARA SIMPLES CONFERENCIA") & t("UNICRED"), "UNICRED_CONTA_CORRENTE").when(t("DATA LANCAMENTOS VALOR") & n("UNICRED"), "UNICRED_CONTA_CORRENTE_NOVO")
        .when(t("COOPERATIVA UNIPRIME") | (n("UNIPRIME") & t("CONTA CORRENTE")), "UNIPRIME_CONTA_CORRENTE").when(t("BANCO BRADESCO") | n("BRADESCO"), "BRADESCO_NET_EMPRESA")
        .when(t("BANCO DA AMAZONIA") | t("AMAZONIA ONLINE") | n("BASA"), "BASA_AMAZONIA_ONLINE").when(t("SICOOB"), "SICOOB_SISBR").when(t("BANCO SAFRA") | n("SAFRA"), "SAFRA_EXTRATO_MOVIMENTACAO")
        .when(t("INSTITUICAO STONE") | (n("STONE") & t("EXTRATO DE CONTA CORRENTE")), "STONE_CONTA_CORRENTE")
        .when(t("LANCAMENTOS DO PERIODO") | (t("LANGAMENTOS") & t("ITAU")) | raw("LANÇAMENTOS PERÍODO") | (t("LANCAMENTOS PERIODO") & n("ITAU")), "ITAU_CONTA_CORRENTE")
        .when(t("DEMONSTRATIVO DE RENTABILIDADE") | t("EXTRATO CONSOLIDADO") | t("INFORMATIVO MENSAL CDB") | n("APLIC"), NO_MOVEMENT)
        .when(~any_text, "PDF_SEM_TEXTO_EXTRAIVEL").otherwise("NAO_SUPORTADO")
    )



def _no_movement(t: Callable[[str], Column]) -> Column:
    """What kind of statement without movement it is."""
    # Codes and marks.
    return (
        F.when(t("UNICRED"), "UNICRED_RENTABILIDADE").when(t("ITAU"), "ITAU_DEMONSTRATIVO_APLICACAO").when(t("CDB CAIXA") | t("INFORMATIVO MENSAL CDB"), "CAIXA_DEMONSTRATIVO_APLICACAO")
        .when(t("BANCO DO NORDESTE") | t("BNB"), "BNB_CONSOLIDADO_INVESTIMENTO").otherwise(NO_MOVEMENT)
    )


def layouts(lines: DataFrame) -> DataFrame:
    """file, layout, code (the layout, or the kind of statement without movement) of every file: one flag a mark, summed
    up before the shuffle."""
    marks: dict[tuple[bool, str], str] = {}
    t = lambda m: F.col(marks.setdefault((False, m), f"m{len(marks)}"))
    raw = lambda m: F.col(marks.setdefault((True, m), f"m{len(marks)}"))
    name = text.normalize_upper(F.element_at(F.split("file", "[/\\\\]"), -1))
    layout, code = detect(t, name, F.col("any_text"), raw), _no_movement(t)
    up = lines.select("file", _upper("line").alias("up"), F.upper(F.coalesce("line", F.lit(""))).alias("raw"))
    per = up.groupBy("file").agg(F.max(F.trim("up") != "").alias("any_text"), *(F.max(F.col("raw" if is_raw else "up").contains(m)).alias(c) for (is_raw, m), c in marks.items()))
    return per.select("file", layout.alias("layout"), code.alias("code")).withColumn("code", F.when(F.col("layout") == NO_MOVEMENT, F.col("code")).otherwise(F.col("layout")))


_GROUPS = ("date", "desc", "value", "doc", "sign", "kind", "neg", "tail")


def _specs(spark: SparkSession) -> DataFrame:
    """The table of layouts: patterns as the JVM reads them, and of the row patterns the numbers of their groups."""
    rows = []
    for name, s in LAYOUTS.items():
        i = "(?iu)" if s.flags & re.I else ""
        one = {k: i + v.replace("(?P<", "(?<") if v else "" for k, v in vars(s).items() if isinstance(v, str)}
        forms = [(i + p.replace("(?P<", "(?<"), {g: re.compile(p).groupindex.get(g, 0) for g in _GROUPS}) for p in s.rows]
        forms += [(r"(?!)", dict.fromkeys(_GROUPS, 0))] * (2 - len(forms))
        year = "(?iu)" + s.year if s.year else ""
        rows.append((name, one["start"], one["stop"], one["skip"], one["no_row"], one["date_line"], one["join"], s.join.startswith("^("), one["join_tail"], one["pending"], one["doc_line"], one["item"], one["item_doc"], one["item_value"], year, s.any_year, "(?iu)" + s.doc_in_desc if s.doc_in_desc else "", s.doc_in_desc.startswith("^"), *[(p, *g.values()) for p, g in forms]))
    form = "struct<p:string," + ",".join(f"{g}:int" for g in _GROUPS) + ">"
    strings = ("start", "stop", "skip", "no_row", "date_line", "join", "join_up", "join_tail", "pending", "doc_line", "item", "item_doc", "item_value", "year", "any_year", "own_doc", "own_lead")
    kinds = ", ".join(f"s_{c} {'boolean' if c in ('join_up', 'own_lead') else 'string'}" for c in strings)
    return F.broadcast(spark.createDataFrame(rows, f"layout string, {kinds}, s_one {form}, s_two {form}"))


def _is(what: Column | str, pattern: str) -> Column:
    """Does a text match the layout's pattern, if it has one?"""
    return (F.col(f"s_{pattern}") != "") & _like(what, F.col(f"s_{pattern}"))


def _like(what: Column | str, pattern: Column) -> Column:
    """regexp_like, but for patterns in columns: regexp_instr keeps the last compiled one, regexp_like compiles each row."""
    return F.regexp_instr(what, pattern) > 0


def _group(what: Column | str, pattern: Column | str, group: Column | int) -> Column:
    what, pattern = (F.col(x) if isinstance(x, str) else x for x in (what, pattern))
    return F.call_function("regexp_extract", what, pattern, F.lit(group) if isinstance(group, int) else group)


def _clean(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _upper(c: str) -> Column:
    """normalize_upper, which plain ASCII does not need in full."""
    line = F.coalesce(c, F.lit(""))
    return F.when(F.length(line) == F.octet_length(line), F.upper(line)).otherwise(text.normalize_upper(c))


def _by_file(lines: DataFrame) -> DataFrame:
    """Files dealt over all tasks: lines are few bytes and much work, so partitions are not to be joined by bytes. All
    windows and groups by file use this one exchange."""
    return lines.select("file", "page", "line_no", "line").repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def _lines(lines: DataFrame) -> DataFrame:
    """Lines with text, of files of known layouts, with their layout's row."""
    spark = lines.sparkSession
    lines = _by_file(lines)
    known = lines.select("file", "page", "line_no", _clean("line").alias("line")).where("line <> ''").join(layouts(lines).select("file", "layout"), "file")
    return known.join(_specs(spark), "layout").withColumn("up", _upper("line"))


def parse(lines: DataFrame) -> DataFrame:
    """ROWS of all files. Files without movement, without text or of an unknown layout give no rows."""
    to_here = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = to_here.rowsBetween(Window.unboundedPreceding, -1)
    whole = to_here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    got = lambda g: F.when(F.col(f"r.{g}") > 0, F.trim(_group("line", "r.p", F.col(f"r.{g}")))).otherwise("")

    # The table: opened by its heading, shut by its end.
    x = _lines(lines).withColumn("is_start", _is("up", "start")).withColumn("is_stop", ~F.col("is_start") & _is("up", "stop"))
    x = x.withColumn("active", F.coalesce(last(F.when(F.col("is_start"), True).when(F.col("is_stop"), False), to_here), F.col("s_start") == "") & ~F.col("is_start") & ~F.col("is_stop"))
    year = lambda p: F.first(F.when(F.col(p) != "", F.nullif(_group("line", p, 1), F.lit(""))), ignorenulls=True).over(whole)
    x = x.withColumn("year", F.coalesce(year("s_year"), year("s_any_year"), F.lit("")))
    # What each line is by itself.
    x = x.withColumn("is_date", F.col("active") & _is("line", "date_line")).withColumn("rest", F.col("active") & ~F.col("is_date") & ~_is("up", "skip"))
    x = x.withColumn("is_item", F.col("rest") & _is("line", "item")).withColumn("rest", F.col("rest") & ~F.col("is_item"))
    x = x.withColumn("r", F.when(F.col("rest") & _like("line", F.col("s_one.p")), F.col("s_one")).when(F.col("rest") & _like("line", F.col("s_two.p")), F.col("s_two")))
    x = x.withColumn("hit", F.col("r").isNotNull()).withColumn("own_date", F.when(F.col("is_date"), _group("line", "s_date_line", 1)).when(F.col("hit"), F.nullif(got("date"), F.lit(""))))
    shuts = F.col("rest") & ~F.col("hit") & _is("line", "item_value")
    x = x.withColumn("date", last(F.col("own_date"), to_here)).withColumn("open", F.coalesce(last(F.when(F.col("is_item"), True).when(shuts, False), before), F.lit(False)))
    # Rows, and lines that belong to an open item or to the last row.
    x = x.withColumn("desc", F.when(F.col("hit"), got("desc")).otherwise("")).withColumn("dated", F.col("hit") & F.col("date").isNotNull())
    x = x.withColumn("void", F.col("dated") & (F.col("desc") != "") & _is(text.normalize_upper("desc"), "no_row")).withColumn("is_row", F.col("dated") & ~F.col("void"))
    x = x.withColumn("alive", F.coalesce(last(F.when(F.col("is_row"), True).when(F.col("void") | F.col("is_stop"), False), before), F.lit(False)))
    joins = F.when(F.col("s_join_up"), _is("up", "join")).otherwise(_is("line", "join"))
    other, alive = F.col("rest") & ~F.col("dated"), F.col("alive")
    role = (
        F.when(F.col("is_row"), "row").when(F.col("is_item"), "item").when(~other, None).when(F.col("open") & ~F.col("hit") & _is("line", "item_value"), "value").when(F.col("open") & ~F.col("hit") & _is("line", "item_doc"), "item_doc")
        .when(alive & _is("line", "doc_line"), "doc").when(alive & _is("line", "join_tail"), "tail").when(alive & joins, "join").when(_is("line", "pending"), "held")
    )
    x = x.withColumn("role", role).withColumn("items", F.col("s_item") != "").withColumn("head", F.coalesce(F.when(F.col("items"), F.col("role") == "item").otherwise(F.col("role") == "row"), F.lit(False)))
    x = x.withColumn("n", F.count(F.when(F.col("head"), 1)).over(to_here) + F.when(F.col("role") == "held", 1).otherwise(0)).withColumn("starts", F.count(F.when(F.col("is_start"), 1)).over(to_here))
    # A row among items is an island of its own.
    x = x.withColumn("alone", F.col("items") & (F.col("role") == "row")).withColumn("n", F.when(F.col("alone"), F.count(F.when(F.col("role") == "row", 1)).over(to_here)).otherwise(F.col("n"))).where("role is not null")
    said = F.when(F.col("role") == "tail", _group("line", "s_join_tail", 1)).when(F.col("role") == "doc", _group("line", "s_doc_line", 1)).when(F.col("role") == "item_doc", _group("line", "s_item_doc", 2)).when(F.col("role") == "value", _group("line", "s_item_value", 1)).otherwise(F.col("line"))
    sign = F.concat_ws("", got("neg"), got("sign"))
    minus = F.when(F.col("is_item"), _group("line", "s_item", 2) != "").otherwise(got("value").contains("-") | sign.contains("-") | F.upper(got("kind")).startswith("D") | got("tail").rlike("[D\uf056]"))
    row = F.struct(
        "page", "line_no", "starts", F.when(F.col("is_item"), _group("line", "s_item", 1)).otherwise(F.col("date")).alias("date"), "year", minus.alias("minus"), values.money_statement(F.when(F.col("hit"), got("value"))).alias("value"), "desc",
        F.when(F.col("hit"), got("doc")).otherwise("").alias("doc"), "s_own_doc", "s_own_lead", "is_item",
    )
    part = F.struct("page", "line_no", "role", F.trim(said).alias("said"), F.when(F.col("role") == "item_doc", _group("line", "s_item_doc", 1)).alias("number"), "starts")
    heads = F.col("head") | F.col("alone")
    islands = x.groupBy("file", "layout", "alone", "n").agg(F.max(F.when(heads, row)).alias("h"), F.array_sort(F.collect_list(F.when(~heads, part))).alias("parts")).where("h is not null")

    h = lambda c: F.col(f"h.{c}")
    of = lambda *roles: F.filter("parts", lambda p: p["role"].isin(*roles) & ((p["role"] != "held") | (p["starts"] == F.col("h.starts"))))
    says = lambda *roles: F.array_join(F.transform(of(*roles), lambda p: p["said"]), " ")
    tail = lambda c: F.try_element_at(c, F.lit(-1))
    y = islands.withColumn("value_line", F.try_element_at(of("value"), F.lit(1))).where("not h.is_item or value_line is not null")
    held = F.trim(F.concat_ws(" ", says("held"), h("desc")))
    y = y.withColumn("d", F.when(h("is_item"), F.trim(F.regexp_replace(F.trim(F.concat_ws(" ", says("held"), says("item_doc"))), r"-+$", ""))).when(held != "", held).otherwise(h("doc")))
    named = (h("s_own_doc") != "") & _like("d", h("s_own_doc"))
    y = y.withColumn("own", F.when(named, F.trim(_group("d", "h.s_own_doc", 1)))).withColumn("d", F.when(named & h("s_own_lead"), F.trim(F.call_function("regexp_replace", F.col("d"), h("s_own_doc"), F.lit("")))).otherwise(F.col("d")))
    y = y.withColumn("d", F.trim(F.concat_ws(" ", F.nullif("d", F.lit("")), F.nullif(says("tail", "join"), F.lit("")))))
    number = F.when(h("is_item"), tail(of("item_doc"))["number"]).otherwise(F.coalesce(F.nullif(tail(of("doc"))["said"], F.lit("")), "own", h("doc")))
    day = F.lower(F.regexp_replace(h("date"), r"\s", ""))
    months = F.create_map(*(F.lit(v) for kv in MONTHS.items() for v in kv))
    month = F.split_part(day, F.lit("/"), F.lit(2))
    at = F.coalesce(F.struct(F.col("value_line.page"), F.col("value_line.line_no")), F.struct(h("page"), h("line_no")))
    y = y.withColumn("at", F.when(h("is_item"), at).otherwise(F.struct(h("page"), h("line_no"))))
    return y.select(
        "file", "layout", h("page").cast("int").alias("page"), F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("row_no"),
        F.when(F.length(day) >= 10, day).otherwise(F.concat(F.split_part(day, F.lit("/"), F.lit(1)), F.lit("/"), F.coalesce(F.try_element_at(months, month), month), F.lit("/"), h("year"))).alias("data"),
        F.when(h("minus"), "SAIDA").otherwise("ENTRADA").alias("tipo"), F.abs(F.when(h("is_item"), values.money_statement("value_line.said")).otherwise(h("value"))).cast("decimal(18,2)").alias("valor"), F.col("d").alias("descricao"),
        F.coalesce(F.nullif(number, F.lit("")), values.document_in("d")).alias("documento"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """file, layout, banco_nome, banco_codigo, empresa_nome, empresa_cnpj, agencia, conta, digito, aviso of every file;
    what the header does not tell is null. layout is the kind of statement for those without movement."""
    after = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(0, SPAN - 1)
    lines = _by_file(lines)
    files = layouts(lines)
    text_of = lines.select("file", "page", "line_no", _clean("line").alias("line")).where("line <> ''").withColumn("few", F.array_join(F.collect_list("line").over(after), "\n")).join(files, "file")
    most = max(map(len, HEADERS.values()))
    found = []
    for k in range(most):  # the first line with a match, its groups
        pattern = F.create_map(*(F.lit(v) for name, ps in HEADERS.items() if len(ps) > k for v in (name, ps[k][0])))
        p = F.try_element_at(pattern, F.col("layout"))
        match = _like("few", p)
        groups = max(len(ps[k][1]) for ps in HEADERS.values() if len(ps) > k)
        size = F.try_element_at(F.create_map(*(F.lit(v) for name, ps in HEADERS.items() if len(ps) > k for v in (name, len(ps[k][1])))), F.col("layout"))
        one = F.struct("page", "line_no", *(F.when(size > g, F.nullif(F.trim(F.regexp_replace(_group("few", p, g + 1), r"\s+", " ")), F.lit(""))).alias(f"g{g}") for g in range(groups)))
        found.append(F.min(F.when(match, one)).alias(f"p{k}"))
    per = files.join(text_of.groupBy("file").agg(*found), "file", "left")

    def field(name: str) -> Column:
        cases = [(layout, [F.col(f"p{k}.g{fields.index(name)}") for k, (_, fields) in enumerate(ps) if name in fields]) for layout, ps in HEADERS.items()]
        out = F.lit(None).cast("string")
        for layout, cols in cases:
            if cols:
                out = F.when(F.col("layout") == layout, F.coalesce(*cols)).otherwise(out)
        return out

    full, short = field(_FULL), field(_SHORT)
    account, digit = values.account_parts(full)
    bank = lambda i: F.try_element_at(F.create_map(*(F.lit(v).cast("string") for name, b in BANKS.items() for v in (name, b[i]))), F.col("code"))
    known = F.col("layout").isin(*LAYOUTS)
    return per.select(
        "file", F.col("code").alias("layout"), F.coalesce(field("banco_nome"), bank(0), F.when(F.col("layout") == "CLINUX_EXTRATO_BANCO", "BANCO CLINUX").otherwise(UNKNOWN_BANK)).alias("banco_nome"), bank(1).alias("banco_codigo"),
        field(_NAME).alias(_NAME), field(_TAX).alias(_TAX), F.coalesce(field(_AG), F.nullif(F.ltrim(short, F.lit("0")), F.lit("")), short).alias(_AG), F.coalesce(field(_ACC), F.when(full.isNotNull(), account)).alias(_ACC),
        F.coalesce(field("digito"), F.when(full.isNotNull(), F.nullif(digit, F.lit("")))).alias("digito"),
        F.when(F.col("layout") == NO_MOVEMENT, NO_ROWS_WARNING).when(F.col("layout") == "CLINUX_EXTRATO_BANCO", ERP_WARNING).when(~known, F.concat(F.lit(UNSUPPORTED_WARNING), "layout")).alias("aviso"),
    )


def cora_declarative(lines: DataFrame) -> DataFrame:
    """The carry-forward layout without Python: the last date line of the file before each movement."""
    l = F.col("line")
    day = F.regexp_extract(l, rf"^({_D})\s+Saldo do dia\s+R\$", 1)
    w = Window.partitionBy("file").orderBy("page", "line_no")
    row = r"^(.+?)\s([+-])\sR\$\s([\d.]+,\d{2})$"
    out = lines.withColumn("data", F.last(F.when(day != "", day), ignorenulls=True).over(w)).where(l.rlike(row) & (day == "") & F.col("data").isNotNull())
    return out.select("file", "page", "data", F.when(F.regexp_extract(l, row, 2) == "+", "ENTRADA").otherwise("SAIDA").alias("tipo"), values.money_statement(F.regexp_extract(l, row, 3)).alias("valor"), F.regexp_extract(l, row, 1).alias("descricao"))
