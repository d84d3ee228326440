"""The resolvers as plain loops over all rows: what the rounds must equal."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable

from tallyforge.functions import fixed, text
from tallyforge.operators import scoring
from tallyforge.operators.features import bank_features, ledger_features
from tallyforge.operators.rounds import exact_subset


def sides(bank, ledger):
    """Bank and ledger rows with features, each in (date, id) order."""
    out = []
    for f, df in ((bank_features, bank), (ledger_features, ledger)):
        rows = [r.asDict() for r in f(df).collect()]
        for r in rows:
            r["tokset"] = set(r["toks"])
            r.setdefault("federal", False), r.setdefault("tax", False), r.setdefault("payee", "")
        out.append(sorted(rows, key=lambda r: (r["data_ref"], r["id"])))
    return out


class Texts:
    """Text questions about pairs, each answered once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], float] = {}

    def similarity(self, b: dict, l: dict) -> float:
        k = (b["norm"], l["norm"])
        if k not in self.known:
            self.known[k] = text.ratio(*k)
        return self.known[k]

    def supplier(self, b: dict, l: dict) -> bool:
        return bool(b["tokset"] & l["tokset"]) or self.similarity(b, l) >= fixed.TEXT_SIMILARITY

    @staticmethod
    def related(b: dict, l: dict) -> bool:
        return bool(b["tokset"] & l["tokset"]) or any(b["tokset"] & w and l["tokset"] & w for w in map(set, fixed.CATEGORIES.values()))



def _gap(a: dict, b: dict) -> int:
    return abs((a["data_ref"] - b["data_ref"]).days)


def _same(a: dict, b: dict) -> bool:
    return a["doc"] != "" and a["doc"] == b["doc"]


def _compatible(a: dict, b: dict) -> bool:
    return _same(a, b) or (len(a["doc"]) == 14 == len(b["doc"]) and a["root"] == b["root"])


def _remark(b: dict, l: dict, texts: Texts) -> str:
    """What differs and what links two rows that are matched by their value alone."""
    differ = [t for on, t in ((b["data_ref"] != l["data_ref"], "data diferente"), (b["doc"] != l["doc"], "CNPJ/CPF diferente ou ausente"), (not texts.supplier(b, l), "fornecedor/prestador diferente ou nao identificado")) if on]
    out = [fixed.NOTE_EQUAL_VALUE]
    if b["federal"] and l["tax"]:
        out.append(fixed.NOTE_TAX)
    if differ:
        out.append("Outras informacoes divergentes: " + ", ".join(differ) + ".")
    cats = sorted(k for k, w in fixed.CATEGORIES.items() if b["tokset"] & set(w) and l["tokset"] & set(w))
    common = sorted(b["tokset"] & l["tokset"])[:5]
    link = "; ".join(f"{name}: {', '.join(x)}" for name, x in (("categorias relacionadas", cats), ("palavras em comum", common)) if x)
    out.append(f"Ligacao textual encontrada: {link}." if link else fixed.NOTE_NO_LINK)
    return " ".join(out)



def _best_of_month(bank: list[dict], ledger: list[dict]) -> list[tuple]:
    """One-to-one of one month, kind and value."""
    texts, used, out = Texts(), set(), []
    for b in bank:
        free = [l for l in ledger if l["id"] not in used]
        if not free:
            break
        free.sort(key=lambda l: (not _compatible(b, l), _gap(b, l), l["id"]))
        best = None
        for l in free[: fixed.SCORED_LIMIT]:
            score, method = scoring.score_pair(b, l, texts.supplier, texts.related, False)
            key = (-score, _gap(b, l), not _same(b, l), not texts.supplier(b, l), -texts.similarity(b, l), l["id"])
            if score and (best is None or key < best[0]):
                best = (key, l, score, method)
        if best:
            _, l, score, method = best
            used.add(l["id"])
            status = scoring.class_of(score, method)
            note = _remark(b, l, texts) if status == "CONCILIADO_VALOR_IGUAL" else ""
            out.append((b["empresa_id"], [b["id"]], [l["id"]], score, method, status, note))
    return out


def _groups_of_month(bank: list[dict], ledger: list[dict]) -> list[tuple]:
    """Instalments of the ledger that sum to a bank row, within a month and kind."""
    texts, used, out = Texts(), set(), []
    by_root, taxes = defaultdict(list), [l for l in ledger if l["tax"]]
    for l in ledger:
        by_root[l["root"]].append(l)
    for b in bank:
        own = by_root[b["root"]] if b["root"] else taxes if b["federal"] else []
        fits = [l for l in own if l["id"] not in used and l["valor"] < b["valor"] and _gap(b, l) <= fixed.SUPPLIER_DAYS and (_compatible(b, l) or (l["tax"] if b["federal"] else texts.supplier(b, l)))]
        if len(fits) < 2:
            continue
        fits.sort(key=lambda l: (not _compatible(b, l), _gap(b, l), l["valor"], l["id"]))
        fits = fits[: fixed.MONTH_GROUP_LIMIT]
        got = [fits[i] for i in exact_subset([l["cents"] for l in fits], b["cents"])]
        if not got:
            continue
        used.update(l["id"] for l in got)
        method, note = "AGRUPAMENTO_SISTEMA_VALOR", "Conciliado por soma exata de parcelas do Sistema contra um lançamento do Banco."
        if b["federal"] and any(l["tax"] for l in got):
            method, note = "AGRUPAMENTO_SISTEMA_TRIBUTO_CAIXA_VALOR", "Tributo/encargo associado a CAIXA ECONOMICA; parcelas do Sistema somam exatamente o valor do Banco."
        elif any(_compatible(b, l) for l in got):
            method = "AGRUPAMENTO_SISTEMA_CNPJ_VALOR"
        out.append((b["empresa_id"], [b["id"]], [l["id"] for l in got], 98, method, "CONCILIADO", note))
    return out



class _Near:
    """Rows by a key, found by distance in days."""

    def __init__(self, rows: Iterable[dict], key: Callable[[dict], object]):
        self.by: dict[object, list[dict]] = defaultdict(list)
        for r in rows:
            self.by[key(r)].append(r)
        self.day = {k: [r["data_ref"].toordinal() for r in v] for k, v in self.by.items()}

    def within(self, key: object, row: dict, days: int) -> list[dict]:
        at = self.day.get(key)
        if not at:
            return []
        d = row["data_ref"].toordinal()
        return self.by[key][bisect_left(at, d - days) : bisect_right(at, d + days)]


class _Account:
    """All passes over one company's rows."""

    def __init__(self, bank: list[dict], ledger: list[dict]):
        self.bank, self.ledger, self.texts, self.out = bank, ledger, Texts(), []
        self.used: tuple[set, set] = (set(), set())
        self.times: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
        for side, rows in enumerate((bank, ledger)):
            for r in rows:
                if r["doc"]:
                    self.times[side][self.quantity_key(r)] += 1

    @staticmethod
    def quantity_key(r: dict) -> tuple:
        return (r["doc"], r["tipo"], r["cents"], r["month"])

    def free(self, side: int, rows: Iterable[dict]) -> list[dict]:
        return [r for r in rows if r["id"] not in self.used[side]]

    def emit(self, banks: list[dict], ledgers: list[dict], score: int, method: str, status: str, note: str = "") -> None:
        self.used[0].update(b["id"] for b in banks)
        self.used[1].update(l["id"] for l in ledgers)
        self.out.append(((banks or ledgers)[0]["empresa_id"], [b["id"] for b in banks], [l["id"] for l in ledgers], score, method, status, note))

    def sums(self, one: dict, many: list[dict], limit: int, cut: bool) -> list[dict]:
        if len(many) < 2 or (len(many) > limit and not cut):
            return []
        many = sorted(many, key=lambda r: (_gap(one, r), r["valor"], r["id"]))[:limit]
        return [many[i] for i in exact_subset([r["cents"] for r in many], one["cents"])]

    def by_document(self, side: int) -> None:
        """Rows of the other side with a compatible document, near in date, that sum to one row of this side."""
        mine, other = (self.bank, self.ledger) if side == 0 else (self.ledger, self.bank)
        index = _Near(other, lambda r: (r["tipo"], r["root"]))
        method = ("AGRUPAMENTO_SISTEMA_CNPJ_DATA_VALOR", "AGRUPAMENTO_BANCO_CNPJ_DATA_VALOR")[side]
        for r in self.free(side, mine):
            if not r["doc"]:
                continue
            fits = [x for x in self.free(1 - side, index.within((r["tipo"], r["root"]), r, fixed.NEAR_DAYS)) if x["valor"] < r["valor"] and _compatible(r, x)]
            if got := self.sums(r, fits, fixed.GROUP_LIMIT, False):
                branch = any(not _same(r, x) for x in got)
                note = fixed.NOTE_BRANCH_GROUP if branch else ""
                self.emit(*(([r], got) if side == 0 else (got, [r])), 98, method, "CONCILIADO", note)

    def by_tax(self, side: int) -> None:
        flag = ("federal", "tax")
        mine, other = (self.bank, self.ledger) if side == 0 else (self.ledger, self.bank)
        index = _Near([x for x in other if x[flag[1 - side]]], lambda r: r["tipo"])
        method = ("AGRUPAMENTO_SISTEMA_TRIBUTO_CAIXA_VALOR", "AGRUPAMENTO_BANCO_TRIBUTO_CAIXA_VALOR")[side]
        for r in self.free(side, mine):
            if not r[flag[side]]:
                continue
            fits = [x for x in self.free(1 - side, index.within(r["tipo"], r, fixed.SUPPLIER_DAYS)) if x["valor"] < r["valor"]]
            if got := self.sums(r, fits, fixed.TAX_GROUP_LIMIT, True):
                self.emit(*(([r], got) if side == 0 else (got, [r])), 98, method, "CONCILIADO", fixed.NOTE_TAX_GROUP)

    def by_payee(self) -> None:
        skip = set(fixed.IGNORED_PAYEE_TOKENS)
        words: dict[str, set] = {}
        for l in self.ledger:
            words.setdefault(l["payee"], {t for t in l["payee"].split() if len(t) >= 4 and not t.isdigit()} - set(fixed.IGNORED_TOKENS) - skip)
        index = _Near(self.ledger, lambda r: r["tipo"])
        for b in self.free(0, self.bank):
            toks = b["tokset"] - skip
            if not toks:
                continue
            payees: dict[str, list[dict]] = {}
            for l in self.free(1, index.within(b["tipo"], b, fixed.NEAR_DAYS)):
                if l["valor"] < b["valor"] and toks & words[l["payee"]]:
                    payees.setdefault(l["payee"], []).append(l)
            for fits in payees.values():
                if got := self.sums(b, fits, fixed.GROUP_LIMIT, False):
                    self.emit([b], got, 98, "AGRUPAMENTO_SISTEMA_FORNECEDOR_DATA_VALOR", "CONCILIADO", fixed.NOTE_PAYEE_GROUP)
                    break

    def pair(self, b: dict, l: dict, score: int, method: str) -> None:
        """Emits a pair after the quantity rule and the remark on equal values."""
        status, note, key = scoring.class_of(score, method), "", self.quantity_key(b)
        if b["doc"] and key == self.quantity_key(l):
            nb, nl = self.times[0][key], self.times[1][key]
            if nb != nl:
                score, status, method = min(score, 72), "POSSIVEL_REVISAO", f"{method}_QTD_DIVERGENTE"
                note = f"Mesmo fornecedor, mes e valor, mas quantidade diferente: banco={nb}, sistema={nl}"
            elif nb > 1:
                note = f"Quantidade mensal conferida: banco={nb}, sistema={nl}"
        if status == "CONCILIADO_VALOR_IGUAL":
            note = _remark(b, l, self.texts)
        self.emit([b], [l], score, method, status, note)

    def strong_pairs(self) -> None:
        """Equal document and value with at least 95, best pairs of all first."""
        index = defaultdict(list)
        for l in self.free(1, self.ledger):
            if l["doc"]:
                index[(l["tipo"], l["cents"], l["doc"])].append(l)
        found = []
        for b in self.free(0, self.bank):
            for l in index.get((b["tipo"], b["cents"], b["doc"]), ()):
                score, method = scoring.score_pair(b, l, self.texts.supplier, self.texts.related, True)
                if score >= 95:
                    found.append(((-score, _gap(b, l), 0, not self.texts.supplier(b, l), -self.texts.similarity(b, l), b["id"], l["id"]), b, l, score, method))
        for _, b, l, score, method in sorted(found, key=lambda x: x[0]):
            if b["id"] not in self.used[0] and l["id"] not in self.used[1]:
                self.pair(b, l, score, method)

    def best_of_rest(self) -> None:
        """Each bank row takes its best free ledger row; of equal scores the first by date and id."""
        value, near = defaultdict(list), _Near([l for l in self.ledger if l["doc"]], lambda r: (r["tipo"], r["doc"]))
        for l in self.ledger:
            value[(l["tipo"], l["cents"])].append(l)
        for b in self.free(0, self.bank):
            best = None
            fits = {l["id"]: l for l in self.free(1, value.get((b["tipo"], b["cents"]), ()))}
            if not fits or b["doc"]:
                fits |= {l["id"]: l for l in self.free(1, near.within((b["tipo"], b["doc"]), b, fixed.NEAR_DAYS))} if b["doc"] else {}
            for l in sorted(fits.values(), key=lambda r: (r["data_ref"], r["id"])):
                score, method = scoring.score_pair(b, l, self.texts.supplier, self.texts.related, True)
                if score and (best is None or score > best[1]):
                    best = (l, score, method)
            if best:
                self.pair(b, *best)
            else:
                self.emit([b], [], 0, "SEM_CORRESPONDENCIA", "NAO_ENCONTRADO")

    def run(self) -> list[tuple]:
        for step in (lambda: self.by_document(0), lambda: self.by_document(1), lambda: self.by_tax(0), lambda: self.by_tax(1), self.by_payee, self.strong_pairs, self.best_of_rest):
            step()
        return self.out


def _unmatched(bank, found):
    used = {i for r in found for i in r[1]}
    return [(b["empresa_id"], [b["id"]], [], 0, "SEM_CORRESPONDENCIA", "NAO_ENCONTRADO", "") for b in bank if b["id"] not in used]


def months(bank, ledger):
    bank, ledger = sides(bank, ledger)
    out = []
    for month, tipo in sorted({(r["month"], r["tipo"]) for r in bank}):
        b, l = ([r for r in rows if (r["month"], r["tipo"]) == (month, tipo)] for rows in (bank, ledger))
        one = [x for v in {r["cents"] for r in b} for x in _best_of_month([r for r in b if r["cents"] == v], [r for r in l if r["cents"] == v])]
        used = [{i for r in one for i in r[k]} for k in (1, 2)]
        out += one + _groups_of_month([r for r in b if r["id"] not in used[0]], [r for r in l if r["id"] not in used[1]])
    return out + _unmatched(bank, out)


def account(bank, ledger):
    bank, ledger = sides(bank, ledger)
    return [x for c in {r["empresa_id"] for r in bank + ledger} for x in _Account([r for r in bank if r["empresa_id"] == c], [r for r in ledger if r["empresa_id"] == c]).run()]


def near(bank, ledger):
    bank, ledger = sides(bank, ledger)
    used, out = set(), []
    for b in bank:
        own = [l for l in ledger if b["root"] and l["root"] == b["root"] and l["tipo"] == b["tipo"]]
        fits = [l for l in own if _gap(b, l) <= 3] or [l for l in own if l["month"] == b["month"]][:20]
        fits = [l for l in fits if l["id"] not in used and l["valor"] != b["valor"]]
        if fits:
            l = min(fits, key=lambda l: (_gap(b, l), abs(b["valor"] - l["valor"]), str(l["id"])))
            used.add(l["id"])
            out.append((b["id"], l["id"], b["valor"] - l["valor"]))
    return out
