"""Repair against an exhaustive search by cost over edits of the whole conversation, without segments or signatures."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallyforge.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if at == 0:
            continue
        text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
        out += [(conv, turn, "user" if at == 4 else role, text)] * (2 if at == 3 else 1)
    return out


def cheapest(rows, must, cut):
    """(cost, audit, repaired lines) by Dijkstra over (rows done, roles so far as a state); a heap entry holds its whole
    audit, so that the first entry of a final state is the least."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = roles[-1:]
        if (i, state) in seen:
            continue
        seen.add((i, state))
        # The whole language is checked on the end state; a last a means (ua)+ is closed.
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        for role, ok in (("u", state in ("", "s", "a")), ("a", state == "u")):
            if ok:
                full = {"u": "user", "a": "assistant"}[role]
                heapq.heappush(heap, (cost + 2, audit + "I", i, role, lines + (f"{full}:",)))
                if i < len(rows) and not must[i]:
                    heapq.heappush(heap, (cost + 2 + cut[i], audit + "R", i + 1, role, lines + (f"{full}:{rows[i][3]}",)))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            own = rows[i][2][:1]
            if not must[i] and (own == "s" and state == "" or own == "u" and state in ("", "s", "a") or own == "a" and state == "u"):
                heapq.heappush(heap, (cost + cut[i], audit + "K", i + 1, own, lines + (f"{rows[i][2]}:{rows[i][3]}",)))


def brute(rows):
    out = []
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, must, cut, n = set(), [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            must.append(fault in ("blank", "duplicate"))
            cut.append(int(fault == "truncated"))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(own, must, cut)
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0)


def check(spark, rows):
    got = [tuple(r) for r in conversation_repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_random_conversations(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "x. ", "long " * 400 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "agent", "User"]), rng.choice(texts + [None])) for c in range(60) for t in range(rng.randrange(1, 12))]
    check(spark, rows)


@pytest.mark.parametrize("segment,fold", [(1, 2), (3, 2), (64, 64)])
def test_segments_and_folds_change_nothing(spark, monkeypatch, segment, fold):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    monkeypatch.setattr(conversation_repair, "FOLD", fold)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(30)}{rng.choice(['.', ''])}") for c in (1, 2) for t in range(150)]
    check(spark, rows)


def test_nulls_ties_gaps_and_repeated_rows(spark):
    rows = [(None, None, "user", "a."), (None, 3, "assistant", "b."), (None, 3, "assistant", "b."), (7, None, "user", "x."), (7, None, "assistant", "y."), (8, 5, None, None), (9, 1, "user", "q?"), (9, 90, "assistant", "r."), (9, 1, "user", "q?"), (9, 1, "system", "　")]
    check(spark, rows)


def test_solve_equals_search():
    rng = random.Random(11)
    for _ in range(300):
        sig = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 9)))
        rows = [(0, k, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "t") for k, c in enumerate(sig)]
        cost, audit, _ = cheapest(rows, [c == "x" for c in sig], [int(c.isupper()) for c in sig])
        assert conversation_repair.finished(conversation_repair.solve(sig)) == (cost, audit), sig


def test_empty_table_and_extra_columns(spark):
    assert conversation_repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "a.", 5, "z"), (1, 1, "assistant", "b.", 6, "z")], SCHEMA + ", seg long, conv string")
    assert [tuple(r) for r in conversation_repair.damage_and_repair(df).collect()] == brute([(1, 0, "user", "a."), (1, 1, "assistant", "b.")])


def test_registered_query_is_the_whole_table(spark, sf):
    from helpers import rows

    from tallyforge.llm.queries import QUERIES

    got = sorted(tuple(r) for r in QUERIES["op12_conversation_repair"](spark, sf).collect())
    assert got == sorted(brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows(sf, "conversations")]))
