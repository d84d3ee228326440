from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import reports, resolve
from tallyforge.operators.lineage import written
from tallyforge.plans.fixtures import bank, ledger
from tallyforge.sources import sinks


def test_the_eight_files_of_a_run(spark, sf, tmp_path):
    b, l = bank(spark, sf).withColumn("banco_nome", F.lit("BANCO X")), ledger(spark, sf).withColumn("categoria", F.lit("C"))
    m = written(resolve.resolve_months(b, l, False), "matches")
    near = written(resolve.near_matches(reports.unmatched(b, m, "bank_ids"), reports.unmatched(l, m, "ledger_ids")), "near")
    made = reports.report_set(m, near, b, l)
    sinks.report_files(made, str(tmp_path))
    read = {n: spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/{n}") for n in made}
    got = {n: df.count() for n, df in read.items()}
    assert sorted(got) == [p for p in sorted(got) if p[:2] in {f"0{k}" for k in range(1, 9)}] and len(got) == 8
    for n in made:
        (file,) = (tmp_path / n).glob("part-*.csv")
        assert file.read_bytes().startswith(b"\xef\xbb\xbf" + made[n].columns[0].encode())
    found = {r["indicador"]: r["valor"] for r in made["01_resumo"].collect()}
    assert got["05_banco_sem_sistema"] == int(found["Banco sem Sistema"]) > 0 and got["06_sistema_sem_banco"] == int(found["Sistema sem Banco"]) > 0
    assert got["02_conciliados"] + got["05_banco_sem_sistema"] == int(found["Quantidade Banco"])
    assert got["03_valor_igual_validar"] == int(found["Conciliados por valor igual para validar"]) and got["04_divergencias"] == 0 and read["04_divergencias"].columns[1:] == reports.MATCH_COLUMNS[1:]
    assert got["08_possiveis_divergencias_valor"] == near.count() > 0
    for r in made["08_possiveis_divergencias_valor"].collect():
        assert r["banco_valor"] - r["sistema_valor"] == r["diferenca_valor"] != Decimal(0) and r["banco_banco"] == "BANCO X" and r["sistema_categoria"] == "C" and r["sistema_empresa"] == ""
    assert {r["banco"] for r in made["05_banco_sem_sistema"].collect()} == {"BANCO X"}


def test_near_rows_of_blank_texts(spark):
    b = spark.createDataFrame([(1, None, None)], "id long, descricao string, documento string").selectExpr("*", "date'2025-01-01' as data_ref", "'SAIDA' as tipo", "cast(1 as decimal(18,2)) as valor")
    l = spark.createDataFrame([(5, None, "-", "")], "id long, favorecido string, descricao string, documento string").selectExpr("*", "date'2025-01-02' as data_ref", "'SAIDA' as tipo", "cast(3 as decimal(18,2)) as valor")
    near = spark.createDataFrame([(1, 5, Decimal(-2))], "bank_id long, ledger_id long, diferenca decimal(18,2)")
    (r,) = reports.near_rows(near, b, l).collect()
    assert (r["sistema_favorecido_descricao"], r["banco_descricao"], r["diferenca_valor"], r["status"]) == ("", None, Decimal(-2), reports.NEAR_STATUS)
    assert reports.near_rows(near.where("false"), b, l).count() == 0
