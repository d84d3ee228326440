import datetime as dt
import json
from decimal import Decimal

from tallyforge.sources import files

HEAD = "data;tipo_movimento;valor;descricao;documento;pagina"


def name(r):
    return r["arquivo"].rsplit("/", 1)[1]


def test_metadata_from_sidecar_first_row_or_defaults(spark, tmp_path):
    row = "05/03/2025;ENTRADA;10.50;pix;;1"
    (tmp_path / "a.csv").write_text(f"{HEAD};banco_nome;conta\n{row};IN FILE;1\n")
    (tmp_path / "a.json").write_text(json.dumps({"metadados": {"banco_nome": "SIDE", "agencia": "12"}, "quantidade_transacoes": 1}, indent=1))
    (tmp_path / "b.csv").write_text(f"banco_nome;conta;{HEAD}\n;7;{row}\nOTHER;8;{row}\n")
    (tmp_path / "b.json").write_text(json.dumps({"metadados": {}}))
    (tmp_path / "c.csv").write_text(f"{HEAD}\n{row}\n06/03/2025;SAIDA;x;;;2\n;SAIDA;1;;;2\n")
    ok, bad = files.bank_files(spark, str(tmp_path), {"banco_nome": "DEFAULT", "agencia": "0"})
    got = sorted((name(r), r["linha"], r["banco_nome"], r["conta"], r["agencia"], r["layout"]) for r in ok.collect())
    # A sidecar counts as a whole: what it does not tell stays empty.
    assert got == [("a.csv", 2, "SIDE", None, "12", None), ("b.csv", 2, "DEFAULT", "7", "0", "CSV_LEGADO"), ("b.csv", 3, "DEFAULT", "7", "0", "CSV_LEGADO"), ("c.csv", 2, "DEFAULT", None, "0", "CSV_LEGADO")]
    one = ok.where("linha = 2").first()
    assert (one["data_ref"], one["valor"], one["pagina"], one["documento"]) == (dt.date(2025, 3, 5), Decimal("10.50"), 1, None)
    assert sorted((name(r), r["linha"], r["_error"]) for r in bad.collect()) == [("c.csv", 3, "valor"), ("c.csv", 4, "data")]


def test_no_sidecars_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n")
    (tmp_path / "b.csv").write_text("")
    ok, bad = files.bank_files(spark, str(tmp_path))
    assert ok.count() == bad.count() == 0


def test_inventory(spark, tmp_path):
    (tmp_path / "i.csv").write_text("status;ano_detectado;layout;arquivo\nIMPORTAVEL;2025;CORA;/x/a.pdf\nERRO_LEITURA;2024;;/x/b.pdf\n;;;\n")
    assert [(r["linha"], r["arquivo"], r["layout"], r["conta"]) for r in files.importable(spark, str(tmp_path / "i.csv")).collect()] == [(2, "/x/a.pdf", "CORA", None)]


def test_sheet_rows(spark):
    cols = "sha256 string, row_no int, data_realizacao string, valor_realizado string, favorecido string, cnpj_cpf string, descricao string, conta string, centro_custo string"
    day = "2025-03-05 00:00:00"
    rows = [("a" * 64, 2, day, "-10.5", " F ", "1", "d", "c", ""), ("a" * 64, 3, day, "0", "", "", "", "", ""), ("a" * 64, 4, day, "x", "", "", "", "", ""), ("a" * 64, 5, None, "1", "", "", "", "", ""), ("a" * 64, 12345, day, "7", None, None, None, None, None)]
    got = files.sheet_ledger(spark.createDataFrame(rows, cols)).collect()
    assert [(r["identificador_externo"], r["tipo"], r["valor"], r["fornecedor_cliente"], r["centro_custo"]) for r in got] == [("SISTEMA-XLS:" + "a" * 16 + ":0002", "SAIDA", Decimal("10.50"), "F", None), ("SISTEMA-XLS:" + "a" * 16 + ":12345", "ENTRADA", Decimal("7.00"), None, None)]
