"""Repair of conversation structure by weighted parsing of role sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch
from trialloom.llm.ordered import fold_groups, sums_before

#: Costs of edits, and of keeping a truncated text.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that one task parses at once.
BLOCK_ROWS = 256
BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# States of a well-formed conversation (s?(ua)+)?: nothing yet, after system, after user, after assistant.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)

#: A cell: for each two states the least (cost, audit) of edits that lead from one to the other over a span, or None.
Cell = tuple[tuple[int, str] | None, ...]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side: productions (p, q) -> (p, r) (r, q)."""
    out: list[tuple[int, str] | None] = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            a = left[p * STATES + r]
            if a is None:
                continue
            for q in range(STATES):
                b = right[r * STATES + q]
                if b is not None:
                    both = (a[0] + b[0], a[1] + b[1])
                    have = out[p * STATES + q]
                    if have is None or both < have:
                        out[p * STATES + q] = both
    return tuple(out)


def _cell(edits: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(edits.get((p, q)) for p in range(STATES) for q in range(STATES))


def _closure() -> Cell:
    """Insertions alone, of user and assistant rows: the cell of an empty span."""
    stay = _cell({(p, p): (0, "") for p in range(STATES)})
    once = _cell({(p, q): (INSERT, "I") for (p, role), q in NEXT.items() if role in "ua"})
    out = stay
    while True:
        longer = combine(out, once)
        best = tuple(min((x for x in pair if x is not None), default=None) for pair in zip(out, longer))
        if best == out:
            return out
        out = best


EMPTY = _closure()


def _leaf(initial: str, fault: str) -> Cell:
    """One row, with insertions on both sides."""
    edits = {(p, p): (DELETE, "D") for p in range(STATES)}
    if fault != "d":
        extra = TRUNCATED if fault == "t" else 0
        for (p, role), q in NEXT.items():
            if role in "ua":
                edits[p, q] = (REROLE + extra, "R")
            if role == initial:
                edits[p, q] = (extra, "K")
    return combine(combine(EMPTY, _cell(edits)), EMPTY)


#: A row's code: its role's initial if the grammar has it, else "-"; then "d" if it must go, "t" if truncated, "k" else.
LEAVES = {i + f: _leaf(i, f) for i in "sua-" for f in "dtk"}


def merge_up(cells: list[Cell]) -> Cell:
    """The cell of a sequence of spans, bottom-up by span length: neighbours are combined until one is left."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def best_audit(cell: Cell) -> tuple[int, str]:
    """Least cost and, among its audits, the ASCII-least, from nothing to a well-formed conversation."""
    return min(cell[q] for q in FINAL if cell[q] is not None)


def repaired_roles(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role) for each edit of an audit; role is None for deletions.

    A repaired conversation has an odd number of rows just if a system row leads it."""
    place = sum(e != "D" for e in audit) % 2  # user rows are at even places after it
    place = -1 if place else 0
    for e in audit:
        if e == "D":
            yield e, None
            continue
        yield e, "system" if place < 0 else ("user", "assistant")[place % 2]
        place += 1


def judge_rows(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, at, turn, role, text, initial, fault): position in the conversation and first fault, or null.

    Faults: blank, duplicate (role and text seen earlier), truncated."""
    rows = sums_before(conversations.select("conv_id", "turn", "role", "text"), scratch, "conv_id", ["turn", "role", "text"], {"at": 1})
    same = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}), 256)
    firsts = rows.groupBy(F.col("conv_id").alias("_conv"), same.alias("_same")).agg(F.min("at").alias("_at")).select("_conv", "_at", F.lit(True).alias("_first"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")), "left")
    text = F.coalesce("text", F.lit(""))
    fault = F.when(text.rlike(BLANK), "blank").when(F.col("_first").isNull(), "duplicate").when(~text.rlike(ENDED), "truncated")
    return scratch.table(rows.select("conv_id", "at", "turn", "role", "text", F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"), fault.alias("fault")), "judged")


def find_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation in the rows of ``judge_rows``.

    A weighted CYK parse. The grammar's nonterminals are pairs (p, q) of states
    of a well-formed conversation: what leads from p to q. Productions join
    (p, r) and (r, q); a terminal is an edit of a row, with insertions closed in
    on both sides. Such nonterminals derive the same from a span however it is
    split (a concatenation of edits is associative, its cost a sum, and of two
    audits of a span neither begins the other unless costs differ), so each span
    is combined once from two halves: spans of 1, 2, 4 ... rows, then blocks of
    256 rows, which different tasks parse, then spans of blocks.
    """
    fault = F.when(F.col("fault") == "truncated", "t").when(F.col("fault").isNotNull(), "d").otherwise("k")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    coded = rows.select("conv_id", F.floor(F.col("at") / BLOCK_ROWS).cast("long").alias("block"), "at", F.concat(initial, fault).alias("code"), "initial")

    def begin() -> dict:
        return {"codes": [], "initials": [], "first": None}

    def add(state: dict, row: dict) -> None:
        state["codes"].append(row["code"])
        state["initials"].append(row["initial"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, held, key, state = None, [], None, None
        remembered: dict[tuple, Cell] = {}

        def done() -> dict:
            codes = tuple(state["codes"])
            cell = remembered.get(codes)
            if cell is None:
                cell = merge_up([LEAVES[c] for c in codes])
                if len(codes) <= 8 and len(remembered) < 10_000:
                    remembered[codes] = cell
            i = state["initials"]
            return {"conv_id": key[0], "block": key[1], "first": i[0], "last": i[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(i, i[1:])), "costs": [-1 if x is None else x[0] for x in cell], "audits": [None if x is None else x[1] for x in cell]}

        for batch in batches:
            shape = shape or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
            for row in batch.to_pylist():
                if (row["conv_id"], row["block"]) != key or state is None:
                    if state is not None:
                        held.append(done())
                    key, state = (row["conv_id"], row["block"]), begin()
                add(state, row)
            if len(held) > 500:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([*held, done()], shape)

    kind = dict(rows.dtypes)["conv_id"]
    dealt = coded.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    blocks = dealt.mapInArrow(parse, f"conv_id {kind}, block long, first string, last string, illegal long, costs array<long>, audits array<string>")

    def start() -> dict:
        return {"spans": [], "last": None, "illegal": 0}

    def step(state: dict, row: dict) -> None:
        state["illegal"] += row["illegal"] + (state["last"] is not None and state["last"] + row["first"] not in LEGAL)
        state["last"] = row["last"]
        # spans of 1, 2, 4 ... blocks; two of one length make one of the next
        size, cell = 1, tuple(None if a is None else (c, a) for c, a in zip(row["costs"], row["audits"]))
        while state["spans"] and state["spans"][-1][0] == size:
            size, cell = 2 * size, combine(state["spans"].pop()[1], cell)
        state["spans"].append((size, cell))

    def end(conv, state: dict) -> dict:
        cell = EMPTY
        for _, c in reversed(state["spans"]):
            cell = combine(c, cell)
        cost, audit = best_audit(cell)
        return {"conv_id": conv, "illegal": state["illegal"], "cost": cost, "audit": audit}

    return fold_groups(blocks, "conv_id", ["block"], "illegal long, cost long, audit string", start, step, end)


LEGAL = {"su", "ua", "au"}


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Repaired rows (conv_id, place, edit, role, text, turn): kept and re-roled rows of ``judge_rows``, and inserted ones with empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("row", pa.int64())])
            for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist()):
                held, row, place = [], 0, 0
                for edit, role in repaired_roles(audit):
                    if edit != "D":
                        held.append({"conv_id": conv, "place": place, "edit": edit, "new_role": None if edit == "K" else role, "row": None if edit == "I" else row})
                        place += 1
                    row += edit != "I"
                    if len(held) > 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    kind = dict(repairs.dtypes)["conv_id"]
    edits = repairs.select("conv_id", "audit").mapInArrow(run, f"conv_id {kind}, place long, edit string, new_role string, row long")
    source = rows.select(F.col("conv_id").alias("_conv"), "at", "turn", "role", "text")
    joined = edits.join(source, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("row") == F.col("at")), "left")
    return joined.select("conv_id", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "turn")


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and its cheapest repair: (report, repaired rows).

    ``conversations`` has conv_id, turn, role, text; other columns take no part.
    Rows are taken in order of turn (nulls first), role, text. The report has
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; repaired
    rows are those of ``apply_repairs``. Keep costs 0, changing a role to user or
    assistant 3, deletion 4, inserting an empty user or assistant row 3, and a
    truncated row that stays 3 more; blank and duplicate rows must be deleted.
    The result's roles are an optional system row and user-assistant pairs, or
    nothing. Of equally cheap repairs the one whose edits' initials are
    ASCII-least is taken.

    Null role and text are empty here: a row with an empty role, or one whose
    initial is not s, u or a, can't be kept as it is. Repeated rows are
    duplicates. A null conv_id is a conversation. Very long texts are only
    hashed and matched in the JVM. No rows give no rows.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = judge_rows(given, scratch)
    repairs = scratch.table(find_repairs(rows), "repairs")
    turns = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    report = repairs.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, apply_repairs(rows, repairs)


def damage_conversations(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a faulty export would give them, by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def digest_repaired(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of the repaired rows as ``role:text``, joined by newlines, streamed in order."""

    def step(state: dict, row: dict) -> None:
        state["sha"].update(("\n" * state["more"] + f"{row['role']}:{row['text']}").encode())
        state["more"] = True

    def end(conv, state: dict) -> dict:
        return {"conv_id": conv, "repaired_sha256": state["sha"].hexdigest()}

    return fold_groups(repaired.select("conv_id", "place", "role", "text"), "conv_id", ["place"], "repaired_sha256 string", lambda: {"sha": hashlib.sha256(), "more": False}, step, end)
