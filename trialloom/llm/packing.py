"""Packing of documents into fixed-length sequences by non-negative least squares."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch

SEPARATOR_ID = 0
PATTERN_DOCS = 3
FIT_ROUNDS = 120
#: Pieces of one length are numbered by tasks of at least so many rows; at most DEALS more groups than lengths.
DEAL_ROWS, DEALS = 500, 20_000


# How byte-level tokenizers cut texts before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def _byte_of_char() -> dict[str, int]:
    """Bytes that byte-level vocabularies write as other characters: those that are not printable, from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(tokenizer_file: str) -> Callable[[str], np.ndarray]:
    """Token ids of a text by a tokenizers file, as ``encode(text, add_special_tokens=False)`` gives them.

    A plain byte-level BPE whose ids rise with its merges is run by tiktoken, which
    gives the same ids in a quarter of the time; texts that hold an added token's
    string, and any other file, are run by tokenizers."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = _load(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def _load(tokenizer_file: str) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    slow = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    if plain:
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if made == sorted(set(made)) and len(made) + 256 == len(vocab):
            import tiktoken

            byte = _byte_of_char()
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            run = tiktoken.Encoding(tokenizer_file, pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
            return lambda text: slow(text) if any(t in text for t in special) else run.encode_to_numpy(text, disallowed_special=())
    return slow


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): token ids as little-endian unsigned 32-bit binary.

    A document's ids are those of its whole text (``encoder``), in which an added
    token's string is that token, then id 0. Documents of more than ``capacity`` ids are cut
    into pieces of ``capacity``, of which the first may be shorter. A null text
    is empty: one piece of one id.
    """

    def run(batches):
        encode = encoder(tokenizer_file)
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            schema = pa.schema([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
            for s in range(0, batch.num_rows, 32):
                part = batch.slice(s, 32)
                rows = {k: [] for k in schema.names}
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(SEPARATOR_ID)).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        for k, v in zip(schema.names, (doc, p, a, b - a, ids[a:b].tobytes())):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def length_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to PATTERN_DOCS lengths that fill a sequence exactly; 0 stands for none."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    two = lengths[(2 * lengths <= capacity) & have[capacity - lengths]]
    out.append(np.stack([two, capacity - two, np.zeros_like(two)], axis=1))
    for a in lengths[3 * lengths <= capacity]:
        b = lengths[(lengths >= a) & (2 * lengths <= capacity - a)]
        c = capacity - a - b
        out.append(np.stack([np.full_like(b, a), b, c], axis=1)[have[c]])
    return np.concatenate(out)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeats whose lengths come nearest to the histogram.

    Multiplicative updates keep repeats non-negative and need two passes over the
    patterns' entries each. Residuals are weighted by one over the count, so that rare
    lengths are fitted too.
    """
    if not len(patterns):
        return np.zeros(0)
    rows, cols = np.nonzero(patterns)
    at = patterns[rows, cols]
    weight = 1.0 / np.maximum(histogram, 1)
    back = lambda y: np.bincount(rows, y[at], len(patterns))
    want = back(weight * histogram)
    x = np.full(len(patterns), histogram[1:].sum() / (PATTERN_DOCS * len(patterns)))
    for _ in range(FIT_ROUNDS):
        made = np.bincount(at, x[rows], len(histogram))
        x *= want / np.maximum(back(weight * made), 1e-12)
    return x


class Plan:
    """Runs of equal sequences: pieces of a length with ranks start.. go to sequences base.. at an offset."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset

    def add(self, lengths: list[int], repeats: int) -> None:
        offset = 0
        for x in lengths:
            self.runs.append((x, int(self.used[x]), self.sequences, offset))
            self.used[x] += repeats
            offset += x
        self.sequences += repeats

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 4)
        return (runs[:, 0] << 44) + runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3]


def make_plan(histogram: np.ndarray, capacity: int) -> Plan:
    """Pack a histogram of lengths (index 0 unused).

    Fitted repeats are rounded down, in falling order and as far as pieces are left;
    what remains is packed best-fit decreasing, all bins of equal contents at once.
    """
    left, plan = histogram.copy(), Plan(capacity)
    patterns = length_patterns(np.flatnonzero(histogram[1:]) + 1, capacity)
    x = fit_repeats(patterns, histogram.astype(float))
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 1:
            break
        lengths = [int(v) for v in patterns[p] if v]
        most = min(left[v] // lengths.count(v) for v in lengths)
        repeats = int(min(most, np.floor(x[p])))
        if repeats > 0:
            plan.add(lengths, repeats)
            for v in lengths:
                left[v] -= repeats
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # free ids -> (bins, their lengths)
    for v in range(capacity, 0, -1):
        todo = int(left[v])
        if not todo:
            continue
        for free in sorted(f for f in room if f >= v):
            # a bin may take several pieces of this length
            while todo and room[free]:
                bins, held = room[free].pop()
                each = min(free // v, -(-todo // bins))
                take = min(bins, todo // each)
                if take < bins:
                    room[free].append((bins - take, held))
                for _ in range(each):
                    held = (held, v)
                room[free - each * v].append((take, held))
                todo -= take * each
            if not todo:
                break
        if todo:
            each = min(capacity // v, todo)
            if todo // each:
                held = ()
                for _ in range(each):
                    held = (held, v)
                room[capacity - each * v].append((todo // each, held))
            if todo % each:
                held = ()
                for _ in range(todo % each):
                    held = (held, v)
                room[capacity - (todo % each) * v].append((1, held))
    for groups in room.values():
        for bins, held in groups:
            lengths = []
            while held:
                held, v = held
                lengths.append(v)
            plan.add(lengths[::-1], bins)
    assert (plan.used == histogram).all(), "every piece has one place"
    return plan


def place_pieces(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """All columns of ``pieces`` plus sequence_id and offset.

    Only the histogram of ``length`` (at most ``capacity`` counts) reaches the
    driver, where patterns of few lengths are fitted to it (``make_plan``).
    Pieces of a length are numbered over all tasks, and a piece's number tells
    its sequence and offset. Common lengths are numbered by many tasks. The
    plan has a bounded number of runs whatever the input. Which of several
    pieces of equal length goes where follows ``order``, ties in any order.

    Lengths must be in 1..capacity. Empty input gives no rows. The result's own
    columns replace columns of these names.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        if r["length"] is None or not 1 <= r["length"] <= capacity:
            raise ValueError(f"a piece of {r['length']} ids does not fit a sequence of {capacity}")
        histogram[r["length"]] = r["count"]
    plan = make_plan(histogram, capacity)
    keys, shift, offsets = plan.arrays()

    rows = max(DEAL_ROWS, int(histogram.sum()) // DEALS)
    many = [(int(v), int(-(-histogram[v] // rows))) for v in np.flatnonzero(histogram > rows)]
    deals = F.broadcast(spark.createDataFrame(many, "length long, _deals int"))  # at most capacity rows
    dealt = pieces.join(deals, "length", "left").withColumn("_deal", F.pmod(F.xxhash64(*order), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    counts = scratch.table(dealt.groupBy("length", "_deal").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    # at most capacity + DEALS rows
    first = F.broadcast(counts.select("length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")))
    within = Window.partitionBy("length", "_deal").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(first, ["length", "_deal"])
    ranked = ranked.select(*pieces.columns, (F.col("_first") + F.col("_rank") - 1).alias("_rank"))
    shared = spark.sparkContext.broadcast((keys, shift, offsets))

    def look_up(batches):
        keys, shift, offsets = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            arrays = [*batch.columns[:-1], pa.array(shift[run] + rank), pa.array(offsets[run])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(look_up, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, lengths): the packed sequences of ``place_pieces``, whose input kept ``ids``.

    A sequence holds at most ``capacity`` pieces, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    packed = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p.ids))
    return packed.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p.length).alias("lengths"))
