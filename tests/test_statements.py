import random
from decimal import Decimal

import lines as loop
import pytest

from tallyforge.sources import statements as st

CASES = {
    "CORA": ("cora.pdf", ["Empresa X", "Agência: 0001 - Conta: 123-4 CORA", "05/03/2025 Saldo do dia R$ 10,00", "PIX recebido FULANO + R$ 1.234,56", "TARIFA - R$ 2,00"], [("05/03/2025", "ENTRADA", "1234.56", "PIX recebido FULANO", ""), ("05/03/2025", "SAIDA", "2.00", "TARIFA", "")]),
    "CAIXA_GERENCIADOR": ("x.pdf", ["EXTRATO POR PERIODO CAIXA", "05/03/2025 000123 PAG BOLETO 250,00 D 1.000,00 C", "05/03/2025 000000 SALDO DIA 0,00 C 1.000,00 C"], [("05/03/2025", "SAIDA", "250.00", "PAG BOLETO", "000123")]),
    "SICOOB_SISBR": ("x.pdf", ["SICOOB", "PERÍODO: 01/03/2025", "05/03 PIX EMITIDO 99,90D", "Fulano de Tal", "DOC.: 777", "06/03 SALDO DO DIA 1,00C"], [("05/03/2025", "SAIDA", "99.90", "PIX EMITIDO Fulano de Tal", "777")]),
    "UNIPRIME_CONTA_CORRENTE": ("uniprime.pdf", ["Cooperativa Uniprime CONTA CORRENTE", "05/03/2025 4455 TARIFA MENSAL 12,00 - 88,00"], [("05/03/2025", "SAIDA", "12.00", "TARIFA MENSAL", "4455")]),
    "BRADESCO_NET_EMPRESA": ("bradesco.pdf", ["BANCO BRADESCO", "Data Lançamento Dcto Saldo", "PAGTO ELETRON", "05/03/2025 998 -10,00 90,00", "DEST: LOJA", "TARIFA", "999 -1,00 89,00"], [("05/03/2025", "SAIDA", "10.00", "PAGTO ELETRON DEST: LOJA", "998"), ("05/03/2025", "SAIDA", "1.00", "TARIFA", "999")]),
    "BANCO_DO_BRASIL_CONTA_CORRENTE": ("extrato bb.pdf", ["05/03/2025 0000 14397 821 Pix - Enviado 33,00 D 10,00 C", "05/03 10:11 JOSE 12345678901"], [("05/03/2025", "SAIDA", "33.00", "Pix - Enviado JOSE 12345678901", "12345678901")]),
    "ITAU_CONTA_CORRENTE": ("itau.pdf", ["ITAU lançamentos do período: 01/03/2025", "data lançamentos valor (R$) saldo (R$)", "05 / mar TAR PACOTE -9,90", "06/03/2025 SALDO DO DIA 1,00", "07/03/2025 PIX RECEB 5,00"], [("05/03/2025", "SAIDA", "9.90", "TAR PACOTE", ""), ("07/03/2025", "ENTRADA", "5.00", "PIX RECEB", "")]),
    "STONE_CONTA_CORRENTE": ("stone.pdf", ["Instituição Stone", "Transferência Pix", "05/03/2025 Débito 7,00 -3,00", "FULANO | 123"], [("05/03/2025", "SAIDA", "7.00", "Instituição Stone Transferência Pix FULANO | 123", "")]),
    "UNICRED_CONTA_CORRENTE_NOVO": ("unicred.pdf", ["Data Lançamentos Valor", "05/03/2025 PIX (Doc.: 55) - R$ 4,00 R$ 9,00", "06/03/2025 TED R$ 6,00 R$ 15,00"], [("05/03/2025", "SAIDA", "4.00", "PIX (Doc.: 55)", "55"), ("06/03/2025", "ENTRADA", "6.00", "TED", "")]),
    "SAFRA_EXTRATO_MOVIMENTACAO": ("safra.pdf", ["BANCO SAFRA Período de 01/03/2025", "LANÇAMENTOS REALIZADOS", "05/03 TED -8,00", "12345678 90"], [("05/03/2025", "SAIDA", "8.00", "TED 12345678 90", "")]),
    "BNB_CONTA_CORRENTE": ("x.pdf", ["Agência/Conta Corrente: 1 - X/2-3 Detalhamento do Extrato", "Data Histórico Documento Valor", "05/03/2025 TARIFA 44 - 3,00 97,00"], [("05/03/2025", "SAIDA", "3.00", "TARIFA", "44")]),
    "CLINUX_EXTRATO_BANCO": ("x.pdf", ["EXTRATO BANCO USUARIO", "05/03/2025 SALDO INICIAL 1,00", "05/03/2025 PAGAMENTO -2,50"], [("05/03/2025", "SAIDA", "2.50", "PAGAMENTO", "")]),
    "BASA_AMAZONIA_ONLINE": ("basa.pdf", ["Movimentações", "05/03/2025 77 PAGTO R$ 5,00 D"], [("05/03/2025", "SAIDA", "5.00", "PAGTO", "77")]),
    "UNICRED_CONTA_CORRENTE": ("x.pdf", ["UNICRED EXTRATO DE CONTA CORRENTE PARA SIMPLES CONFERENCIA", "05/03/2025 12 TARIFA -1,00 9,00"], [("05/03/2025", "SAIDA", "1.00", "TARIFA", "12")]),
    "CAIXA_EXTRATO_NOVO": ("caixa.pdf", ["Extrato no período", "Data Documento Histórico Valor", "05/03/2025 000123 PIX ENVIADO - R$ 10,00 R$ 90,00 C"], [("05/03/2025", "SAIDA", "10.00", "PIX ENVIADO", "000123")]),
    "DEMONSTRATIVO_SEM_MOVIMENTO_TRANSACIONAL": ("aplic.pdf", ["Extrato consolidado", "05/03/2025 X 1,00"], []),
    "NAO_SUPORTADO": ("x.pdf", ["nada"], []),
    "PDF_SEM_TEXTO_EXTRAIVEL": ("y.pdf", [""], []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(f"{k}/{name}", 1, i, line) for k, (name, lines, _) in CASES.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, st.LINES)
    return {r["file"].split("/")[0]: r["layout"] for r in st.layouts(df).collect()}, st.parse(df).collect(), st.cora_declarative(df.where("file like 'CORA%'")).collect()


def test_layouts(parsed):
    assert parsed[0] == {k: k for k in CASES}


@pytest.mark.parametrize("layout", CASES)
def test_rows(parsed, layout):
    got = [(r["data"], r["tipo"], r["valor"], r["descricao"], r["documento"]) for r in sorted(parsed[1], key=lambda r: r["row_no"]) if r["file"].startswith(layout + "/")]
    assert got == [(d, t, Decimal(v), x, n) for d, t, v, x, n in CASES[layout][2]]


def test_declarative_form_agrees(parsed):
    assert [(r["data"], r["tipo"], str(r["valor"]), r["descricao"]) for r in parsed[2]] == [x[:4] for x in CASES["CORA"][2]]


def rows_of(spark, files):
    df = spark.createDataFrame([(name, 1, i, line) for name, lines in files.items() for i, line in enumerate(lines)], st.LINES)
    out = {}
    for r in sorted(st.parse(df).collect(), key=lambda r: (r["file"], r["row_no"])):
        out.setdefault(r["file"], []).append((r["data"], r["tipo"], str(r["valor"]), r["descricao"], r["documento"]))
    return out


def test_caixa_rows_over_several_lines(spark):
    lines = [
        "Extrato no período", "Data Documento Histórico Valor", "PIX RECEBIDO -", "05/03/2025", "000124 JOSE R$ 110,00 C", "05/03 10:22:01", "R$ 20,00", "TARIFA", "06/03/2025 -", "000125 CESTA", "- R$ 7,50",
        "SALDO DIA R$ 102,50 C", "solto", "07/03/2025 000126 SALDO DE CONTA R$ 1,00 R$ 103,50 C", "08/03/2025 -", "R$ 2,00",
    ]
    assert rows_of(spark, {"caixa.pdf": lines})["caixa.pdf"] == [
        ("05/03/2025", "ENTRADA", "20.00", "PIX RECEBIDO - JOSE", "000124"), ("06/03/2025", "SAIDA", "7.50", "TARIFA CESTA", "000125"),
        ("07/03/2025", "ENTRADA", "1.00", "SALDO DE CONTA", "000126"), ("08/03/2025", "SAIDA", "2.00", "solto", ""),
    ]


def test_random_lines_equal_the_loop(spark):
    rng = random.Random(7)
    bits = [
        "05/03/2025", "06/03/2025 -", "000124 JOSE R$ 110,00 C", "R$ 20,00", "- R$ 7,50", "FULANO | 123", "SALDO ANTERIOR 1,00", "SALDO DO DIA R$ 1,00", "DEST: LOJA 12345678901", "12345678 90", "DOC.: 777", "solto", "", "05/03 10:11 JOSE 12345678901", "SALDOS",
        "CENTRAL DE RELACIONAMENTO", "Detalhamento do saldo", "999 -1,00 89,00", "05/03/2025 1,00 2,00", "PIX (Doc.: 55)", "SALDO DA CONTA CORRENTE",
    ]
    files = {}
    for k, (name, lines, _) in CASES.items():
        if k in st.LAYOUTS:
            for n in range(8):
                files[f"{k}/{n}/{name}"] = lines[:2] + [" ".join(rng.choice(bits + lines * 3).split()) for _ in range(40)]
    got = rows_of(spark, files)
    for name, lines in files.items():
        want = [(r["data"], r["tipo"], str(r["valor"]), r["descricao"].strip(), r["documento"]) for r in loop.read_lines(st.LAYOUTS[name.split("/")[0]], [(1, x) for x in lines])]
        assert got.get(name, []) == want, name


def test_headers(spark):
    files = {
        "cora.pdf": (["ACME LTDA", "CNPJ 12.345.678/0001-90", "Agência: 0001 - Conta: 123-4 CORA"], ("CORA", "BANCO CORA", None, "ACME LTDA", "12.345.678/0001-90", "0001", "123", "4", None)),
        "bradesco.pdf": (["BANCO BRADESCO", "ACME | CNPJ: 12.345.678/0001-90", "0123 | 1.234-5"], ("BRADESCO_NET_EMPRESA", "BANCO BRADESCO", "237", "ACME", "12.345.678/0001-90", "123", "1234", "5", None)),
        "stone.pdf": (["Titular ACME", "Instituição Stone", "Documento 12.345.678/0001-90", "Agência 0001", "Conta 77-1"], ("STONE_CONTA_CORRENTE", "STONE", None, "ACME", "12.345.678/0001-90", "0001", "77", "1", None)),
        "itau.pdf": (["lançamentos do período: 01/03/2025", "ACME CNPJ Agência 11 Conta 22-3", "12.345.678/0001-90"], ("ITAU_CONTA_CORRENTE", "BANCO ITAU", "341", "ACME", "12.345.678/0001-90", "11", "22", "3", None)),
        "aplic.pdf": (["Extrato consolidado do BNB"], ("BNB_CONSOLIDADO_INVESTIMENTO", "BANCO DO NORDESTE", "004", None, None, None, None, None, st.NO_ROWS_WARNING)),
        "z.pdf": (["nada"], ("NAO_SUPORTADO", st.UNKNOWN_BANK, None, None, None, None, None, None, st.UNSUPPORTED_WARNING + "NAO_SUPORTADO")),
        "e.pdf": ([None], ("PDF_SEM_TEXTO_EXTRAIVEL", st.UNKNOWN_BANK, None, None, None, None, None, None, st.UNSUPPORTED_WARNING + "PDF_SEM_TEXTO_EXTRAIVEL")),
    }
    df = spark.createDataFrame([(name, 1, i, line) for name, (lines, _) in files.items() for i, line in enumerate(lines)], st.LINES)
    assert {r["file"]: tuple(r)[1:] for r in st.headers(df).collect()} == {k: want for k, (_, want) in files.items()}


def test_itau_by_its_accented_heading(spark):
    df = spark.createDataFrame([("x.pdf", 1, 1, "lançamentos período: 01/03/2025")], st.LINES)
    assert st.layouts(df).first()["layout"] == "ITAU_CONTA_CORRENTE"
