"""The statement machine as a loop over the lines of one file: the oracle of `statements.parse`."""

import re
import unicodedata
from decimal import Decimal

from tallyforge.sources.statements import MONTHS, Layout


def _upper(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper()


def _money(s: str) -> Decimal:
    s = re.sub(r"[R$\s]", "", s)
    return Decimal(s.replace(".", "").replace(",", ".") if "," in s else s)


_DOC = re.compile(r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|\b\d{11,14}\b")


def read_lines(spec: Layout, lines: list[tuple[int, str]]) -> list[dict]:
    """The rows of one file: (page, line) in order."""
    on = lambda p, f=0: re.compile(p, f) if p else None
    rows, start, stop, skip, no_row = [re.compile(p, spec.flags) for p in spec.rows], on(spec.start), on(spec.stop), on(spec.skip), on(spec.no_row)
    join, tail, pending, doc_line, date_line, own_doc = on(spec.join), on(spec.join_tail), on(spec.pending), on(spec.doc_line), on(spec.date_line), on(spec.doc_in_desc, re.I)
    item, item_doc, item_value = on(spec.item), on(spec.item_doc), on(spec.item_value)
    year = ""
    whole = "\n".join(l for _, l in lines)
    if m := spec.year and re.search(spec.year, whole, re.I) or spec.any_year and re.search(spec.any_year, whole):
        year = m[1]
    inside, date, held, last, out, open_ = not start, "", [], None, [], None
    for page, raw in lines:
        line = " ".join(raw.split())
        up = _upper(line)
        if not line:
            continue
        if start and start.search(up):
            inside, held = True, []
            continue
        if not inside:
            continue
        if stop and stop.search(up):
            inside = not start
            last = None
            continue
        if date_line and (m := date_line.match(line)):
            date = m[1]
            continue
        if skip and skip.search(up):
            continue
        if item and (m := item.match(line)):
            open_ = {"page": page, "data": m[1], "tipo": "SAIDA" if m[2] else "ENTRADA", "descricao": " ".join(held), "documento": ""}
            held = []
            continue
        hit = next((m for p in rows if (m := p.match(line))), None)
        if open_ and not hit and (m := item_value.search(line)):
            desc = open_["descricao"].rstrip("-").strip()
            out.append(open_ | {"valor": abs(_money(m[1])), "descricao": desc, "documento": open_["documento"] or next(iter(_DOC.findall(desc)), "")})
            open_ = None
            continue
        if open_ and not hit and (m := item_doc.match(line)):
            open_ |= {"documento": m[1], "descricao": f"{open_['descricao']} {m[2]}".strip()}
            continue
        got = hit.groupdict() if hit else {}
        if hit and (got.get("date") or date):
            date = got.get("date") or date
            desc = (got.get("desc") or "").strip()
            if desc and no_row.search(_upper(desc)):
                last = None
                continue
            if not item:
                desc = " ".join([*held, desc] if desc else held) or got.get("doc") or ""
                held = []
            value, kind = _money(got["value"]), _upper(got.get("kind") or "")
            minus = value < 0 or "-" in (got.get("neg") or "") or got.get("sign") == "-" or kind.startswith("D") or "\uf056" in (got.get("tail") or "") or "D" in (got.get("tail") or "")
            doc = got.get("doc") or ""
            if own_doc and (m := own_doc.search(desc)):
                doc = m[1].strip()
                if spec.doc_in_desc.startswith("^"):
                    desc = desc[m.end() :].strip()
            day = re.sub(r"\s", "", date).lower()
            if len(day) < 10:
                d, mth = day.split("/")
                day = f"{d}/{MONTHS.get(mth, mth)}/{year}"
            last = {"page": page, "data": day, "tipo": "SAIDA" if minus else "ENTRADA", "valor": abs(value), "descricao": desc, "documento": doc or next(iter(_DOC.findall(desc)), "")}
            out.append(last)
        elif last and doc_line and (m := doc_line.match(line)):
            last["documento"] = m[1].strip()
        elif last and tail and (m := tail.match(line)):
            last["descricao"] += " " + m[1].strip()
            last["documento"] = last["documento"] or next(iter(_DOC.findall(last["descricao"])), "")
        elif last and join and join.search(up if spec.join.startswith("^(") else line):
            last["descricao"] += " " + line
            last["documento"] = last["documento"] or next(iter(_DOC.findall(last["descricao"])), "")
        elif pending and pending.search(line):
            held.append(line)
    return out
