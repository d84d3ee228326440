import csv
import datetime as dt
import io
import random
from decimal import Decimal

from tallyforge.sources import dialects, files

TEXTS = ["", "plain", "a;b", "x,y", 'say "hi"', "two\nlines", "three\n\nlines", "é ç", " pad ", '";,\n"']


def made(path, sep, n, seed, bom=False, blank=False):
    """A file of n rows; what a CSV reader must find in it."""
    g, out = random.Random(seed), io.StringIO()
    rows = [[str(k), g.choice(TEXTS), g.choice(TEXTS), g.choice(["1", "2,5", ""])] for k in range(n)]
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerow(["id", "one", "two", "valor"])
    for r in rows:
        w.writerow(r)
        if blank and g.random() < 0.2:
            out.write("\n")
    path.write_text(out.getvalue(), encoding="utf-8-sig" if bom else "utf-8", newline="")
    return {(path.name, k + 2): tuple(v.strip(" ") or None for v in r) for k, r in enumerate(rows)}


def read(spark, path, columns=("id", "one", "two", "valor")):
    return {(r["arquivo"].rsplit("/", 1)[1], r["linha"]): tuple(r[c] for c in columns) for r in dialects.table(spark, str(path), columns).collect()}


def test_files_of_two_dialects_with_records_over_lines(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    want = made(d / "a.csv", ";", 300, 1, bom=True) | made(d / "b.csv", ",", 200, 2, blank=True) | made(d / "c.csv", ";", 0, 3) | made(d / "d.csv", ",", 1, 4)
    (d / "e.csv").write_text("")
    assert read(spark, d) == want


def test_blocks_of_a_file_carry_open_quotes_and_numbers(spark, tmp_path):
    """Files are cut into many small blocks, often inside a record."""
    d = tmp_path / "in"
    d.mkdir()
    want = made(d / "a.csv", ";", 400, 5) | made(d / "b.csv", ",", 400, 6, bom=True, blank=True)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(d)).rdd.getNumPartitions() > 20
        assert read(spark, d) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_stray_quotes_blank_rows_and_columns(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "stray.csv").write_text('id;one\n1;5" pipe\n2;b\n\n3;c\n')
    (d / "wide.csv").write_text(' "id" , one ,extra,one\n1,a,x,last,more\n,,,\n3,,\n')
    got = read(spark, d, ("id", "one", "none"))
    assert got == {("stray.csv", 2): ("1", '5" pipe', None), ("stray.csv", 3): ("2", "b", None), ("stray.csv", 4): ("3", "c", None), ("wide.csv", 2): ("1", "last", None), ("wide.csv", 4): ("3", None, None)}


def test_ledger_files_and_their_rejects(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("empresa_id;tipo_movimento;valor;data_pagamento;descricao\n1;Receita;1.234,50;05/03/2025;\"um;\ndois\"\n1;Receita;3;;\n", encoding="utf-8-sig")
    (d / "b.csv").write_text("valor,empresa_id,tipo_movimento,data_lancamento,sistema_origem\n7,2,despesa,2025-03-06,X\n\n8,x,despesa,2025-03-06,X\n")
    (d / "c.csv").write_text("empresa_id;descricao\n1;x\n")
    ok, bad = files.ledger_csv(spark, str(d))
    name = lambda r: r["arquivo"].rsplit("/", 1)[1]
    assert sorted((name(r), r["linha"], r["empresa_id"], r["tipo"], r["valor"], r["data_ref"], r["descricao"], r["sistema_origem"], r["status"]) for r in ok.collect()) == [
        ("a.csv", 2, 1, "ENTRADA", Decimal("1234.50"), dt.date(2025, 3, 5), "um;\ndois", None, "ABERTO"),
        ("b.csv", 2, 2, "SAIDA", Decimal("7.00"), dt.date(2025, 3, 6), None, "X", "ABERTO"),
    ]
    assert sorted((name(r), r["linha"], r["_error"]) for r in bad.collect()) == [("a.csv", 3, "data_lancamento_ou_data_pagamento"), ("b.csv", 3, "empresa_id"), ("c.csv", 2, "colunas ausentes: tipo_movimento, valor")]
