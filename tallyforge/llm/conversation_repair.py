"""Conversation structure repair: find the faults of each turn, and the cheapest edits to a well-formed conversation.

A conversation is well formed if its role initials are `(s?(ua)+)?`. Rows are taken by turn (nulls first, ties by role
and text), and each row becomes one symbol: its initial (s, u, a, or o for any other), in upper case if its text is
truncated, or x if it must go (blank, or role and text seen earlier). Rows are dealt by ranges of (conversation, turn,
role, beginning of text), so that a conversation of any length spreads over tasks, and cut into segments of at most
SEGMENT rows, whose symbols are a signature. Each distinct signature is solved once, by memoised recursion over (place,
state): for each state before it (0 nothing yet, 1 after s, 2 after u, 3 after a) and each state after it, the least
cost and the ASCII-least edits that reach it. Equal-cost edits of a segment end in a row's edit and have one for each row,
so none is the beginning of another, and segments of one conversation combine in any grouping: in rounds of FOLD.

The audit (K keep, R rerole, D delete, I insert, in order) is then replayed on the rows, one conversation after another
in a stream that holds one row at a time; SHA-256 is sequential, so this last step alone sees a conversation in one task.

Null conv_id, turn, role and text are one space in what is hashed and compared; rows of null conv_id are one
conversation. Empty texts are blank; texts are taken whole. Repeated rows are duplicates, all but the first. Role and
text are known by a 128-bit hash. A conversation without rows has zeros, an empty audit and the empty string's hash.
Other columns are not carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._spark import parallelism, small_batches, written

SEGMENT, FOLD = 64, 64
BLANK = " \t\n\x0b\x0c\r"
#: The role that may follow in each state, and the state after it.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
STATES = 4
Way = tuple[int, str]


def _rows(conversations: DataFrame) -> DataFrame:
    """conv (conv_id as text), turn, role, text; nulls of all but turn are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text of what is left after faults are put in by the hash of `conv_id:turn`."""
    rows = _rows(conversations)
    at = F.pmod(F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")), F.lit(20))
    rows = rows.withColumn("_at", at).where("_at <> 0")
    text = F.when(F.col("_at") == 1, "").when(F.col("_at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_at") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def _segmented(rows: DataFrame) -> DataFrame:
    """conv, seg, pos, turn, role, text, key (of role and text) and sym without what duplicates change. Segments of a
    conversation ascend in its order."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    n = parallelism(rows.sparkSession)
    ranged = rows.repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, pos, last = TaskContext.get().partitionId() << 40, -1, None
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                pos += 1
                if conv != last or pos == SEGMENT:
                    seg, pos, last = seg + 1, 0, conv
                body = text.rstrip(BLANK)
                sym = role[:1] if role[:1] in ("s", "u", "a") else "o"
                sym = "x" if not body else sym if body[-1] in ".!?" else sym.upper()
                key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                out.append((seg, pos, key, sym))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string())
            more = [pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.record_batch([b.column(c) for c in ("conv", "turn", "role", "text")] + more, names=["conv", "turn", "role", "text", "seg", "pos", "key", "sym"])

    return ranged.select("conv", "turn", "role", "text").mapInArrow(run, "conv string, turn long, role string, text string, seg long, pos int, key binary, sym string")


def _legal(pair: Column) -> Column:
    return pair.isin("su", "ua", "au")


def _segments(rows: DataFrame) -> DataFrame:
    """One row for each segment: its signature, counts of faults, and what its borders need."""
    place = F.struct("seg", "pos")
    again = rows.groupBy("conv", "key").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    marked = rows.join(again, ["conv", "key"], "left").withColumn("dup", F.col("first").isNotNull() & (place > F.col("first")))
    blank = F.col("sym") == "x"
    marked = marked.select("conv", "seg", F.struct("pos", F.substring("role", 1, 1).alias("initial"), "turn", F.when(F.col("dup"), "x").otherwise(F.col("sym")).alias("sym")).alias("row"), blank.alias("blank"), (~blank & F.col("dup")).alias("duplicate"))
    # A segment has SEGMENT rows at most.
    got = marked.groupBy("conv", "seg").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"))
    signature = F.array_join(F.transform("rows", lambda r: r["sym"]), "")
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(F.slice("rows", 2, SEGMENT), F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))), lambda b, a: F.concat(a["initial"], b["initial"]))
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))
    return got.select(
        "conv", "seg", signature.alias("sig"), "blank", "duplicate", F.length(F.translate(signature, "suaox", "")).cast("long").alias("truncated"), F.size(F.filter(pairs, lambda p: ~_legal(p))).alias("illegal"),
        F.size(turns).alias("turns"), F.array_min(turns).alias("least"), F.array_max(turns).alias("most"), initials[0].alias("begins"), F.element_at(initials, -1).alias("ends"),
    )


def solve(sig: str) -> list[list[Way | None]]:
    """For each state before and after: (cost, edits) of the cheapest way through the rows, ASCII-least of equals.
    Rows are inserted before a row only, two at most (a third would come back to the state of the first)."""

    @lru_cache(maxsize=None)
    def ways(i: int, state: int) -> tuple[Way | None, ...]:
        if i == len(sig):
            return tuple((0, "") if s == state else None for s in range(STATES))
        best: list[Way | None] = [None] * STATES
        at = state
        for k in range(3):
            for letter, cost, after in _edits(sig[i], at):
                for end, way in enumerate(ways(i + 1, after)):
                    if way is not None:
                        mine = (2 * k + cost + way[0], "I" * k + letter + way[1])
                        best[end] = mine if best[end] is None else min(best[end], mine)
            at = NEXT[at][1]
        return tuple(best)

    return [list(ways(0, s)) for s in range(STATES)]


def _edits(sym: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what may be done with a row."""
    out = [("D", 3, state)]
    if sym != "x":
        more, (role, after) = int(sym.isupper()), NEXT[state]
        out.append(("R", 2 + more, after))
        if sym.lower() == role:
            out.append(("K", more, after))
        elif sym.lower() == "s" and state == 0:
            out.append(("K", more, 1))
    return out


def joined(parts: list[list[list[Way | None]]]) -> list[list[Way | None]]:
    """The ways through several runs of rows, one after another."""
    got = parts[0]
    for part in parts[1:]:
        got = [[min((((a := row[m])[0] + (b := part[m][end])[0], a[1] + b[1]) for m in range(STATES) if row[m] and part[m][end]), default=None) for end in range(STATES)] for row in got]
    return got


def finished(ways: list[list[Way | None]]) -> Way:
    """The cheapest whole repair, with what is inserted at the end."""
    return min((w[0] + 2 * k, w[1] + "I" * k) for w, k in zip(ways[0], (0, 2, 1, 0), strict=True) if w)


_WAYS = "array<struct<cost:int, edits:string>>"
_WAYS_PA = pa.list_(pa.struct([("cost", pa.int32()), ("edits", pa.string())]))


def _flat(ways: list[list[Way | None]]) -> list[dict | None]:
    return [w and {"cost": w[0], "edits": w[1]} for row in ways for w in row]


def _square(flat: list[dict | None]) -> list[list[Way | None]]:
    ways = [w and (w["cost"], w["edits"]) for w in flat]
    return [ways[s * STATES : (s + 1) * STATES] for s in range(STATES)]


def _solved(segments: DataFrame) -> DataFrame:
    """conv, cost, audit. Segments take their ways from the distinct signatures; those of one conversation are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([_flat(solve(s)) for s in b.column(0).to_pylist()], _WAYS_PA)], names=["sig", "ways"])

    def fold(g: pa.Table) -> pa.Table:
        g = g.sort_by("no")
        ways = joined([_square(x) for x in g.column("ways").to_pylist()])
        return pa.table([g.column("conv").slice(0, 1), g.column("to").slice(0, 1), pa.array([_flat(ways)], _WAYS_PA)], names=["conv", "no", "ways"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [finished(_square(x)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], names=["conv", "cost", "audit"])

    solved = segments.select("sig").distinct().mapInArrow(run, f"sig string, ways {_WAYS}")
    left = written(segments.withColumn("no", F.row_number().over(Window.partitionBy("conv").orderBy("seg")) - 1).select("conv", F.col("no").cast("long").alias("no"), "sig").join(solved, "sig").drop("sig"), "ways")
    while (left.agg(F.max("no")).first()[0] or 0) > 0:  # each round leaves one of FOLD
        dealt = left.withColumn("to", F.floor(F.col("no") / FOLD).cast("long"))
        per = dealt.groupBy("conv", "to").agg(F.count("*").alias("n"))
        dealt = dealt.join(per, ["conv", "to"])
        alone = dealt.where("n = 1").select("conv", F.col("to").alias("no"), "ways")
        left = written(alone.unionByName(dealt.where("n > 1").drop("n").groupBy("conv", "to").applyInArrow(fold, f"conv string, no long, ways {_WAYS}")), "ways")
    return left.select("conv", "ways").mapInArrow(end, "conv string, cost long, audit string")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the repaired `role:text` lines. rows: conv, seg, pos, role, text; audits: conv, audit."""
    first = audits.select("conv", F.lit(-1).cast("long").alias("seg"), F.lit(0).alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = first.unionByName(rows.select("conv", "seg", "pos", "role", "text")).repartition(parallelism(rows.sparkSession), "conv").sortWithinPartitions("conv", "seg", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = digest = None
        audit, at, state, lines = "", 0, 0, 0

        def line(role: str, text: str) -> None:
            nonlocal lines
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1

        def inserted() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                role, state = NEXT[state]
                line("user" if role == "u" else "assistant", "")
                at += 1

        def done() -> pa.RecordBatch:
            inserted()
            return pa.record_batch([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

        for b in batches:
            for c, seg, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "seg", "role", "text")), strict=True):
                if seg < 0:
                    if digest:
                        yield done()
                    conv, digest, audit, at, state, lines = c, hashlib.sha256(), text, 0, 0, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = 1 if role[:1] == "s" else NEXT[state][1]
                    line(role, text)
                elif edit == "R":
                    to, state = NEXT[state]
                    line("user" if to == "u" else "assistant", text)
        if digest:
            yield done()

    return both.mapInArrow(run, "conv string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (conv, turn, role, text)."""
    small_batches(rows.sparkSession)
    rows = written(_segmented(rows), "turns")
    segments = written(_segments(rows.drop("text")), "segments")
    before = Window.partitionBy("conv").orderBy("seg")
    # At the borders of segments: an illegal step, and a turn that both sides have.
    most = F.last("most", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    step = F.concat(F.lag("ends").over(before), F.col("begins"))
    edges = segments.select("*", F.when(step.isNotNull() & ~_legal(step), 1).otherwise(0).alias("step"), F.when(most == F.col("least"), 1).otherwise(0).alias("same"))
    total = lambda c: F.sum(c).cast("long").alias(c)
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.col("same")), F.lit(0)).cast("long").alias("gaps")
    counts = edges.groupBy("conv").agg(gaps, total("blank"), total("duplicate"), total("truncated"), F.sum(F.col("illegal") + F.col("step")).cast("long").alias("illegal"))
    audits = written(_solved(segments), "audits")
    return counts.join(audits, "conv").join(replayed(rows, audits), "conv")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Every conv_id with what its damaged rows need: the query's result."""
    kind = conversations.schema["conv_id"].dataType
    got = repair(damaged(conversations))
    all_of = _rows(conversations).select("conv").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    conv_id = F.when(F.col("conv") != " ", F.col("conv").cast(kind)).alias("conv_id")
    return all_of.join(got, "conv", "left").select(conv_id, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
