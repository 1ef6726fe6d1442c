"""Chat transcripts as training windows of a token budget, with a loss mask, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch
from trialloom.llm.ordered import fold_groups, sums_before
from trialloom.llm.packing import encoder

START, END = "<|im_start|>", "<|im_end|>"
#: A conversation is cut into blocks of so many budgets; windows start afresh in each.
BLOCK_BUDGETS = 64
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_IN = {v: k for k, v in _ROLE_OUT.items()}


def escape(text: str) -> str:
    """Text in which no control string is left: a backslash more after each ``<`` that opens one."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return "".join(_ROLE_OUT.get(c, c) for c in role)


def _unescape_role(role: str) -> str:
    return re.sub(r"\\.", lambda m: _ROLE_IN[m[0]], role)


def _sized(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """Turns as the template writes them: escaped role and body, and the tokens of the whole turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                roles = [_escape_role(r) for r in part.column("role").to_pylist()]
                bodies = [escape(t) for t in part.column("text").to_pylist()]
                tokens = [len(encode(f"{START}{r}\n{b}{END}\n")) for r, b in zip(roles, bodies)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(roles, pa.string()), pa.array(bodies, pa.string()), pa.array(tokens, pa.int64())], names=["conv_id", "turn", "role", "body", "tokens"])

    kinds = dict(turns.dtypes)
    return turns.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, body string, tokens long")


def plan_windows(tokens: np.ndarray, owned: int, system: int, kept: bool, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Spans (context start, start, end) of turns, from prefix sums of their tokens.

    The first ``owned`` turns are history alone. ``system`` tokens are repeated
    in each window but the one that begins with the system turn itself
    (``kept``: turn ``owned`` is it). A window's history is the longest run of
    turns before it within ``history`` tokens; it shrinks where the next turn
    would not fit. A turn that does not fit at all is a window of its own.
    """
    upto = np.concatenate([[0], np.cumsum(tokens)])
    out, at, least = [], owned, owned + kept if kept else 0
    while at < len(tokens):
        own = kept and at == owned
        room = budget - (0 if own else system)
        back = max(least, int(np.searchsorted(upto, upto[at] - history))) if not own else at
        back = max(min(back, at), int(np.searchsorted(upto, upto[at + 1] - room))) if not own else at
        back = min(back, at)
        end = max(at + 1, int(np.searchsorted(upto, upto[back] + room, side="right")) - 1)
        out.append((back, at, min(end, len(tokens))))
        at = out[-1][2]
    return out


def format_windows(conversations: DataFrame, tokenizer_file: str, budget: int = 1024, history: int = 256, system_limit: int = 256, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Windows (conv_id, block, part, text, loss, tokens, turns, context, over_budget) of all conversations.

    ``conversations`` has conv_id, turn, role, text; other columns take no part.
    A window's text is its turns in the template; ``context`` of its ``turns``
    are repeated ones: the system turn, if the conversation begins with one of
    at most ``system_limit`` tokens, and history of at most ``history`` tokens.
    ``loss`` lists the code point spans of the target roles' texts among the
    other turns, so each target is learned once and repeats are masked. Windows
    are in order of (block, part).

    Windows hold at most ``budget`` tokens, counted turn by turn, but for a turn
    that does not fit beside the system turn: it is never cut, and stands in a
    window of its own that is marked ``over_budget``. Windows start afresh after
    every 64 budgets of a conversation, so a conversation is never in one task.

    Rows are in order of turn, then role, then text, nulls first. Null role or
    text: empty. Rows with a null conv_id are one conversation. Repeated rows
    are turns of their own. An empty table gives no rows.
    """
    if system_limit + history >= budget:
        raise ValueError("the system turn and history must leave room for turns")
    scratch = Scratch(conversations.sparkSession, "chat")
    kind = dict(conversations.dtypes)["conv_id"]
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = sums_before(given, scratch, "conv_id", ["turn", "role", "text"], {"upto": "tokens", "at": 1}, lambda rows: _sized(rows, tokenizer_file))
    span = BLOCK_BUDGETS * budget
    turns = turns.withColumn("block", F.floor(F.col("upto") / span).cast("long"))
    leads = (F.col("at") == 0) & (F.col("role") == "system") & (F.col("tokens") <= system_limit)
    # a turn goes to its block, and as history to the next one if it may lie within reach of it
    near = (F.col("upto") >= (F.col("block") + 1) * span - history) & (F.col("tokens") <= history) & ~leads
    kinds = F.filter(F.array(F.struct(F.lit(2).alias("kind"), F.col("block")), F.when(near, F.struct(F.lit(1).alias("kind"), (F.col("block") + 1).alias("block")))), lambda x: x.isNotNull())
    dealt = turns.select("conv_id", F.explode(kinds).alias("to"), "at", "role", "body", "tokens", leads.alias("leads")).select("conv_id", "to.block", "to.kind", "at", "role", "body", "tokens", "leads")
    # and the system turn to all blocks after the first
    blocks = turns.groupBy("conv_id").agg(F.max("block").alias("last")).where("last > 0").withColumnRenamed("conv_id", "_conv")
    system = turns.where(leads).join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("block"), F.lit(0).alias("kind"), "at", "role", "body", "tokens", F.lit(True).alias("leads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, held, key, rows, chars = None, [], None, [], 0
        for batch in batches:
            shape = shape or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_WINDOW])
            for row in batch.to_pylist():
                if rows and (row["conv_id"], row["block"]) != key:
                    made = _windows_of_block(rows, budget, history, targets)
                    held, chars, rows = held + made, chars + sum(len(w["text"]) for w in made), []
                key = (row["conv_id"], row["block"])
                rows.append(row)
                if chars > 1 << 20:
                    yield pa.RecordBatch.from_pylist(held, shape)
                    held, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(held + _windows_of_block(rows, budget, history, targets), shape)

    every = dealt.unionByName(system).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "at")
    return every.mapInArrow(run, f"conv_id {kind}, block long, part int, text string, loss array<struct<start:int,end:int>>, tokens long, turns int, context int, over_budget boolean")


_WINDOW = [("block", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("tokens", pa.int64()), ("turns", pa.int32()), ("context", pa.int32()), ("over_budget", pa.bool_())]


def _windows_of_block(rows: list[dict], budget: int, history: int, targets: tuple[str, ...]) -> list[dict]:
    """Windows of a block's turns; rows are the repeated system turn, history of the block before, then own turns."""
    system = rows.pop(0) if rows[0]["kind"] == 0 else None
    owned = sum(r["kind"] == 1 for r in rows)
    own_lead = owned < len(rows) and rows[owned]["leads"]
    system = rows[owned] if own_lead else system
    out = []
    for back, start, end in plan_windows(np.array([r["tokens"] for r in rows], np.int64), owned, system["tokens"] if system else 0, own_lead, budget, history):
        repeated = [] if system is None or own_lead and start == owned else [system]
        repeated += rows[back:start]
        text, at, loss = [], 0, []
        for n, r in enumerate(repeated + rows[start:end]):
            head = f"{START}{r['role']}\n"
            if n >= len(repeated) and _unescape_role(r["role"]) in targets:
                loss.append({"start": at + len(head), "end": at + len(head) + len(r["body"])})
            text.append(f"{head}{r['body']}{END}\n")
            at += len(text[-1])
        tokens = sum(r["tokens"] for r in repeated + rows[start:end])
        out.append({"conv_id": rows[start]["conv_id"], "block": rows[start]["block"], "part": len(out), "text": "".join(text), "loss": loss, "tokens": tokens, "turns": end - start + len(repeated), "context": len(repeated), "over_budget": tokens > budget})
    return out


def parse_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window's text; an error if it is not the template's."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a formatted window from character {at} on")
    return turns


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation what reading its windows back gives: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars). Repeated turns are
    left out, texts under the mask are unescaped. Windows are streamed in order."""

    def start() -> dict:
        return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}

    def step(state: dict, row: dict) -> None:
        for role, text in parse_window(row["text"])[row["context"] :]:
            state["n"] += 1
            state["turns"].update(f"{role}\n{text}\n".encode())
        for span in row["loss"]:
            learned = unescape(row["text"][span["start"] : span["end"]])
            state["chars"] += len(learned)
            state["loss"].update(learned.encode())
        state["all"] += len(row["text"])

    def end(conv, state: dict) -> dict:
        return {"conv_id": conv, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["all"]}

    return fold_groups(windows.select("conv_id", "block", "part", "text", "loss", "context"), "conv_id", ["block", "part"], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", start, step, end)
