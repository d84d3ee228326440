import datetime as dt
import random
from decimal import Decimal
from itertools import combinations

import loops
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text, values
from tallyforge.operators import candidates, etl, reports, resolve, rounds, scoring
from tallyforge.operators.features import bank_features, ledger_features
from tallyforge.plans.fixtures import bank, ledger
from tallyforge.sources import files, sinks
from tallyforge.streaming import incremental

BANK = "id long, data_ref date, tipo string, valor decimal(18,2), descricao string, documento string, empresa_id long"
LEDGER = "id long, data_ref date, tipo string, valor decimal(18,2), favorecido string, descricao string, documento string, empresa_id long"
D = dt.date(1995, 3, 10)


def day(n):
    return D + dt.timedelta(n)


def b(i, v, n=0, text="", doc="", tipo="SAIDA"):
    return (i, day(n), tipo, Decimal(v), text, doc, 1)


def l(i, v, n=0, who="", text="", doc="", tipo="SAIDA"):
    return (i, day(n), tipo, Decimal(v), who, text, doc, 1)


DOC, BRANCH = "12345678000100", "12345678000200"
#: (bank, ledger, score of one account, score of all accounts)
RULES = [
    (b(1, 10, 0, "", DOC), l(1, 10, 0, "", "", DOC), 100, 100), (b(1, 10, 0, "", DOC), l(1, 10, 3, "", "", DOC), 95, 95), (b(1, 10, 0, "LOJA AZUL", DOC), l(1, 10, 9, "loja azul", "", DOC), 96, 96),
    (b(1, 10, 0, "qqqq", DOC), l(1, 10, 9, "zzzz", "", DOC), 88, 88), (b(1, 10, 0, "loja azul", DOC), l(1, 10, 9, "loja azul", "", BRANCH), 82, 96), (b(1, 10, 0, "qqqq", DOC), l(1, 10, 9, "zzzz", "", BRANCH), 70, 88),
    (b(1, 10, 0, "caixa economica"), l(1, 10, 2, "", "darf"), 94, 94), (b(1, 10, 0, "caixa economica"), l(1, 10, 30, "", "darf"), 92, 92), (b(1, 10, 0, "caixa economica"), l(1, 10, 60, "", "darf"), 86, 92),
    (b(1, 10, 0, "loja azul"), l(1, 10, 0, "loja azul"), 90, 90), (b(1, 10, 0, "loja azul"), l(1, 10, 2, "loja azul"), 85, 85), (b(1, 10, 0, "loja azul"), l(1, 10, 20, "loja azul"), 82, 82), (b(1, 10, 0, "qqqq"), l(1, 10, 0, "zzzz"), 80, 80),
    (b(1, 10, 0, "qqqq"), l(1, 10, 3, "zzzz"), 75, 75), (b(1, 10, 0, "gasolina"), l(1, 10, 30, "frete"), 74, 74), (b(1, 10, 0, "qqqq"), l(1, 10, 30, "zzzz"), 70, 70), (b(1, 10, 0, "", DOC), l(1, 11, 1, "", "", DOC), 60, 60),
    (b(1, 10, 0, "", DOC), l(1, 11, 1, "", "", BRANCH), 0, 60), (b(1, 10, 0, "", DOC), l(1, 10, 0, "", "", DOC, "ENTRADA"), 0, 0),
]


def test_every_rule_in_both_dialects_and_both_forms(spark):
    rows = [((k, *x[0][1:]), (k, *x[1][1:])) for k, x in enumerate(RULES)]
    bs, ls = bank_features(spark.createDataFrame([r[0] for r in rows], BANK)), ledger_features(spark.createDataFrame([r[1] for r in rows], LEDGER))
    pairs = candidates.prefixed(bs, "b_").join(candidates.prefixed(ls, "l_"), F.col("b_id") == F.col("l_id"))
    for by_account, score in ((True, scoring.score_account), (False, scoring.score_month)):
        got = {r["b_id"]: (r["score"], r["metodo"], r["status"]) for r in score(pairs).collect()}
        assert [got[k][0] for k in range(len(RULES))] == [x[2 if by_account else 3] for x in RULES]
        t = loops.Texts()
        for r in pairs.collect():
            x, y = ({c[2:]: v for c, v in r.asDict().items() if c.startswith(p)} for p in ("b_", "l_"))
            x["tokset"], y["tokset"] = set(x["toks"]), set(y["toks"])
            s, m = scoring.score_pair(x, y, t.supplier, t.related, by_account)
            assert (s, m, scoring.class_of(s, m)) == got[r["b_id"]]


def test_exact_subset_agrees_with_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        v = [r.randrange(1, 60) for _ in range(r.randrange(1, 11))]
        target = r.randrange(1, 200)
        got = rounds.exact_subset(v, target)
        any_ = any(sum(c) == target for k in range(1, len(v) + 1) for c in combinations(v, k))
        assert bool(got) == any_ and (not got or (sum(v[i] for i in got) == target and got == sorted(set(got))))
    assert rounds.exact_subset([30, 20, 10, 50], 50) == [0, 1]


def test_months_on_fixtures(spark, sf):
    bs, ls = bank(spark, sf), ledger(spark, sf)
    whole = resolve.resolve_months(bs, ls).collect()
    m, none = [r for r in whole if r["ledger_ids"]], [r for r in whole if not r["ledger_ids"]]
    assert {(r["score"], r["metodo"], r["status"]) for r in none} == {(0, "SEM_CORRESPONDENCIA", "NAO_ENCONTRADO")} and all(len(r["bank_ids"]) == 1 for r in none)
    assert all(r["observacao"].startswith("Conciliado automaticamente porque") for r in m if r["status"] == "CONCILIADO_VALOR_IGUAL")
    banks, ledgers = [i for r in m for i in r["bank_ids"]], [i for r in m for i in r["ledger_ids"]]
    assert len(banks) == len(set(banks)) and len(ledgers) == len(set(ledgers))
    bv, lv = {r["id"]: r for r in bs.collect()}, {r["id"]: r for r in ls.collect()}
    want = {0: 100, 4: 90}
    for r in m:
        x, ys = bv[r["bank_ids"][0]], [lv[i] for i in r["ledger_ids"]]
        assert sum(y["valor"] for y in ys) == x["valor"] and all(y["data_ref"].strftime("%Y%m") == x["data_ref"].strftime("%Y%m") for y in ys)
        if x["id"] % 13 in want and len(ys) == 1:
            assert r["score"] == want[x["id"] % 13]
    groups = [r for r in m if len(r["ledger_ids"]) > 1]
    assert {r["bank_ids"][0] % 13 for r in groups} <= {8, 12} and len(groups) > 50 and all(r["score"] == 98 for r in groups)
    left = reports.unmatched(bs, resolve.resolve_months(bs, ls), "bank_ids").count()
    assert left == len(bv) - len(banks) == len(none)
    report = reports.match_rows(resolve.resolve_months(bs, ls), bs.withColumn("conta", F.lit("c1")), ls)
    assert report.columns == reports.MATCH_COLUMNS and report.count() == len(m) and {r["banco_conta"] for r in report.collect()} == {"c1"}
    sums = {r["indicador"]: r["valor"] for r in reports.summary(resolve.resolve_months(bs, ls), bs, ls).collect()}
    done = sum(r["status"] in ("CONCILIADO", "CONCILIADO_VALOR_IGUAL") for r in m)
    assert len(sums) == 15 and sums["Quantidade Banco"] == str(len(bv)) and sums["Banco sem Sistema"] == str(len(none)) and sums["Sistema sem Banco"] == str(len(lv) - len(ledgers)) and sums["% Banco conciliado"] == f"{done / len(bv):.4f}"
    near = resolve.near_matches(reports.unmatched(bs, resolve.resolve_months(bs, ls), "bank_ids"), reports.unmatched(ls, resolve.resolve_months(bs, ls), "ledger_ids")).collect()
    assert near and all(r["diferenca"] == bv[r["bank_id"]]["valor"] - lv[r["ledger_id"]]["valor"] != 0 for r in near)


def test_account_passes(spark):
    bs = [b(1, 100, 0, "PAGTO", DOC), b(2, 30, 0, "PAGTO", DOC), b(3, 20, 1, "PAGTO", DOC), b(4, 77, 0, "CAIXA ECONOMICA FEDERAL"), b(5, 64, 0, "PIX PADARIA CENTRAL"), b(6, 15, 0, "qqqq", "99999999000100"), b(7, 41, 0, "nada")]
    ls = [l(1, 60, 0, "f", "", DOC), l(2, 40, 1, "f", "", DOC), l(3, 50, 1, "f", "", DOC), l(4, 70, 9, "", "darf"), l(5, 7, 9, "", "inss"), l(6, 60, 1, "Padaria Central"), l(7, 4, 1, "Padaria Central"), l(8, 15, 0, "zzzz", "", "99999999000100"), l(9, 15, 1, "zzzz", "", "99999999000100")]
    got = {tuple(r["bank_ids"]): (tuple(sorted(r["ledger_ids"])), r["metodo"], r["score"], r["status"]) for r in resolve.resolve_account(spark.createDataFrame(bs, BANK), spark.createDataFrame(ls, LEDGER)).collect()}
    assert got[(1,)] == ((1, 2), "AGRUPAMENTO_SISTEMA_CNPJ_DATA_VALOR", 98, "CONCILIADO")
    assert got[(3, 2)] == ((3,), "AGRUPAMENTO_BANCO_CNPJ_DATA_VALOR", 98, "CONCILIADO")
    assert got[(4,)][:2] == ((4, 5), "AGRUPAMENTO_SISTEMA_TRIBUTO_CAIXA_VALOR") and got[(5,)][:2] == ((6, 7), "AGRUPAMENTO_SISTEMA_FORNECEDOR_DATA_VALOR")
    assert got[(6,)] == ((8,), "CNPJ_VALOR_DATA_QTD_DIVERGENTE", 72, "POSSIVEL_REVISAO") and got[(7,)][3] == "NAO_ENCONTRADO"


def test_text_and_values(spark):
    one = spark.range(1)
    got = one.select(
        text.normalize(F.lit("  Ação: ÉTICA nº 1ª ")).alias("n"), text.normalize(F.lit(None).cast("string")).alias("z"), text.normalize_upper(F.lit("São João-x")).alias("u"), text.doc_root(F.lit("12.345.678/0001-00")).alias("r"), values.money_statement(F.lit("R$ 1.234,56")).alias("m1"),
        values.money_ledger(F.lit("1234.56")).alias("m2"), values.money_ofx(F.lit("-15,50")).alias("m3"), values.money_ofx(F.lit("x")).alias("m4"), values.date_any(F.lit("5/3/2025")).alias("d1"), values.date_any(F.lit("x")).alias("d2"), values.date_ofx(F.lit("20250305120000")).alias("d3"), values.brl(F.lit(Decimal("1234567.8"))).alias("b"),
    ).first()
    assert tuple(got) == ("acao etica no 1a", "", "SAO JOAO-X", "12345678", Decimal("1234.56"), Decimal("123456.00"), Decimal("15.50"), Decimal("0.00"), dt.date(2025, 3, 5), None, dt.date(2025, 3, 5), "R$ 1.234.567,80")
    assert text.ratio("tide", "diet") != text.ratio("diet", "tide")


def test_etl(spark):
    links, heads = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "conciliacao_id long, lancamento_id long"), spark.createDataFrame([(1,), (2,)], "id long")
    facts, origin = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, None)], "id long, sistema_origem string"), spark.createDataFrame([("A",), ("B",)], "origem string")
    k, h, f, o = etl.replace_origin(links, heads, facts, origin, "A")
    assert [r[0] for r in h.collect()] == [1] and k.count() == 1 and sorted(r["id"] for r in f.collect()) == [2, 4] and o.count() == 1
    new = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4)], "k long, v long")
    assert etl.append_new(new.where("false"), new, ["k"]).count() == 3 and etl.append_new(new, new, ["k"]).count() == 2
    kept, old = etl.retain(spark.createDataFrame([(D, 1), (None, 2)], "d date, valor int"), "d", "2000-01-01")
    assert kept.count() == 1 and old.count() == 1
    assert "a" in etl.run_log(new, {"a": "1"}).first()["parametros"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("empresa_id;tipo_movimento;valor;data_pagamento\n1;Receita;1.234,50;05/03/2025\n1;X;2;\n2;DESPESA;;\n3;debit;7;2025-13-40\n", encoding="utf-8-sig")
    ok, bad = files.ledger_csv(spark, str(tmp_path / "l.csv"))
    assert [(r["tipo"], r["valor"], r["data_ref"]) for r in ok.collect()] == [("ENTRADA", Decimal("1234.50"), dt.date(2025, 3, 5))]
    assert sorted(r["_error"] for r in bad.collect()) == ["data_pagamento_invalida", "tipo_movimento", "valor"]
    body = "<OFX><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20250305120000<TRNAMT>-15,50<FITID>A1<MEMO>TARIFA AÇÃO</STMTTRN><STMTTRN><TRNTYPE>XFER<TRNAMT>1<MEMO>SALDO ANTERIOR</STMTTRN></OFX>"
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.ofx").write_bytes(body.encode("cp1252"))
    (tmp_path / "o" / "b.OFX").write_bytes(body.encode())
    got = files.ofx_files(spark, str(tmp_path / "o")).collect()
    assert sorted((r["tipo"] or "", str(r["valor"]), r["descricao"], r["registro"]) for r in got) == sorted([("SAIDA", "15.50", "TARIFA AÇÃO", "MOVIMENTACAO"), ("", "1.00", "SALDO ANTERIOR", "SALDO_ANTERIOR")] * 2)
    found = files.listing(spark, str(tmp_path), (".OFX",))
    assert found.count() == 2 and files.pending(found, spark.createDataFrame([(found.first()["path"].upper(), "OK")], "arquivo string, status_importacao string")).count() == 1
    df = spark.createDataFrame([(1, ""), (2, "bad")], "a int, _error string")
    assert sinks.publish(df, str(tmp_path / "p")) and spark.read.parquet(str(tmp_path / "p")).count() == 2 and not sinks.publish(df, str(tmp_path / "p"), "_error <> ''", 0)
    sinks.good_and_bad(df, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/ok")).count() == 1
    sinks.report_csv(df, str(tmp_path / "r"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "r")).count() == 2
    assert sinks.workbook({"x": df}, str(tmp_path / "w.xlsx")) in ("csv", "xlsx")


def test_workbook_limits_only_the_ledger_only_sheet(spark, tmp_path, monkeypatch):
    import sys
    from types import SimpleNamespace

    n, books = 20_003, []
    sheets = {"Conciliados": spark.range(n), "Sistema sem Banco": spark.range(n), "Duplicidades": spark.range(0)}
    read = lambda p: spark.read.option("sep", ";").option("header", True).csv(str(p)).count()
    monkeypatch.setitem(sys.modules, "openpyxl", None)
    assert sinks.workbook(sheets, str(tmp_path / "c")) == "csv"
    assert [read(tmp_path / "c" / x) for x in ("Conciliados", "Sistema sem Banco")] == [n, n]

    class Book(dict):
        def __init__(self, write_only):
            books.append(self)

        def create_sheet(self, name):
            return self.setdefault(name, [])

        def save(self, path):
            pass

    monkeypatch.setitem(sys.modules, "openpyxl", SimpleNamespace(Workbook=Book))
    assert sinks.workbook(sheets, str(tmp_path / "w.xlsx")) == "xlsx"
    assert {k: len(v) for k, v in books[0].items()} == {"Conciliados": n + 1, "Sistema sem Banco": 20_001, "Duplicidades": 1, "Observacao": 1}
    assert read(tmp_path / "w.xlsx.csv" / "Sistema sem Banco") == n
    monkeypatch.setattr(sinks, "_EXCEL_ROWS", 11)
    sinks.workbook({"x": spark.range(25)}, str(tmp_path / "x.xlsx"))
    assert {k: len(v) for k, v in books[1].items()} == {"x": 11, "x (2)": 11, "x (3)": 6}


def test_stream_is_idempotent(spark, sf, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ev.union(ev.limit(50)).repartition(3).write.parquet(src)
    for k in range(2):
        s = incremental.deduplicated(spark.readStream.schema(ev.schema).parquet(src), "ts", ["event_id"])
        q = s.writeStream.foreachBatch(incremental.idempotent_sink(spark, out, ["event_id"])).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.read.parquet(out).count() == ev.count()
    assert incremental.windowed_totals(ev, "ts", "1 day").agg(F.sum("n")).first()[0] == ev.count()


@pytest.mark.parametrize("name", ["resolve_account", "report_matches", "report_summary", "near_matches"])
def test_rows_only_queries(spark, sf, name):
    from tallyforge.plans.queries import QUERIES

    assert QUERIES[name](spark, sf).count() > 0


def test_scoring_pairs_by_root_hold_all_pairs_with_a_score(spark):
    import datetime as dt
    import itertools
    from decimal import Decimal

    from tallyforge.functions.text import ratio
    from tallyforge.operators import candidates, scoring
    from tallyforge.operators.features import bank_features, ledger_features

    docs, day = ["12345678000100", "12345678000200", "12345678", "99999999000100", ""], dt.date(1995, 3, 1)
    rows = [(k, day + dt.timedelta(k % 6), "SAIDA", Decimal(10 + k % 3), "loja sul", d) for k, d in enumerate(docs * 3)]
    bank = bank_features(spark.createDataFrame(rows, "id long, data_ref date, tipo string, valor decimal(18,2), descricao string, documento string"))
    ledger = ledger_features(spark.createDataFrame([(*r[:4], "loja azul", "", r[5]) for r in rows], "id long, data_ref date, tipo string, valor decimal(18,2), favorecido string, descricao string, documento string"))
    supplier = lambda b, l: bool(set(b["toks"]) & set(l["toks"])) or ratio(b["norm"], l["norm"]) >= 0.35
    sides = [[r.asDict() for r in f.collect()] for f in (bank, ledger)]
    want = {(b["id"], l["id"], scoring.score_pair(b, l, supplier, lambda *_: False, False)[0]) for b, l in itertools.product(*sides)}
    got = scoring.score_month(candidates.scoring_pairs(bank, ledger, True)).select("b_id", "l_id", "score").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == {x for x in want if x[2]}
    fewer = scoring.score_month(candidates.scoring_pairs(bank, ledger)).count()
    assert fewer < len(got)
