"""Secret scans: fixed patterns plus character Markov models of random strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.llm.common import Scratch, span_hashes, text_buffers, text_parts

# The base patterns, in the order in which kinds are listed, and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 16
# a run of these characters shorter than HEX_LEAST is never a match: the longest run is taken from its start
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Strings that the models judge: runs of these characters, so long at least, with up to two pad marks after them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN_LEAST = 12
#: Rules and fillers ("--------") have fewer different characters.
RUN_DISTINCT = 5
PAD, PADS = "=", 2
STATES = len(ALPHABET)
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(STATES)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_CLASS = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * 4)
_CLASS_SIZE = np.array([26, 26, 10, 4])
#: Bins of log-likelihood ratios, one nat each, in which held-out strings are counted.
BINS = np.arange(-200, 201)
#: Weight of what follows one character in what follows two.
BACKOFF = 20.0
#: Taken off each count after two characters, and given to what follows one.
DISCOUNT = 1.0
#: The least share of random runs that is reckoned with, and by how much a false find outweighs a miss.
FEWEST, FALSE_COST = 1e-6, 1000.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that are long enough, in order; ends are exclusive."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(spans)


def secret_values(text: str) -> list[str]:
    """What the base patterns hold: the labelled random strings."""
    out = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [m[0] for m in HEX_LONG.finditer(text)]


def runs_of(raw: np.ndarray, offsets: np.ndarray, least: int = RUN_LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each longest run of ALPHABET with ``least`` or more characters, and its row."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _CODE[raw] >= 0
    before = np.concatenate([[False], inside[:-1]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
    long = ends - starts >= least
    return starts[long], ends[long], np.searchsorted(offsets, starts[long], side="right") - 1


def transitions(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of first characters (row STATES) and of characters after characters in byte spans of ALPHABET."""
    counts = np.zeros((STATES + 1, STATES))
    if len(starts):
        code = _CODE[raw]
        counts[STATES] = np.bincount(code[starts], minlength=STATES)
        inner = np.zeros(len(raw) + 1, np.int64)
        np.add.at(inner, starts, 1)
        np.add.at(inner, ends - 1, -1)
        at = np.flatnonzero(np.cumsum(inner)[:-1] > 0)  # all but each span's last character
        counts[:STATES] = np.bincount(code[at] * STATES + code[at + 1], minlength=STATES**2).reshape(STATES, STATES)
    return counts


def triples(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of characters after two characters in byte spans of ALPHABET."""
    inner = np.zeros(len(raw) + 1, np.int64)
    long = ends - starts > 2
    np.add.at(inner, starts[long], 1)
    np.add.at(inner, ends[long] - 2, -1)
    at = np.flatnonzero(np.cumsum(inner)[:-1] > 0)  # all but each span's last two characters
    code = _CODE[raw]
    return np.bincount((code[at] * STATES + code[at + 1]) * STATES + code[at + 2], minlength=STATES**3).reshape(STATES, STATES, STATES).astype(float)


@dataclass(frozen=True)
class MarkovModels:
    """Log-probabilities of characters after characters (the last row: of first ones) in random and in ordinary strings.

    ``further`` are those of characters after two, in ordinary strings: two
    characters tell the language that a word is of, so that words of a rarer one
    are not judged by the others' letters. Without it ``ordinary`` holds throughout."""

    random: np.ndarray
    ordinary: np.ndarray
    threshold: float
    further: np.ndarray | None = None
    recall: float | None = None
    found_share: float | None = None

    @staticmethod
    def fit(random: np.ndarray, ordinary: np.ndarray, threshold: float, further: np.ndarray | None = None) -> MarkovModels:
        """From transition counts, each row smoothed towards the strings' own letters, and these towards all characters;
        counts after two characters are smoothed towards those after the second."""

        def log_p(counts: np.ndarray, weight: float) -> np.ndarray:
            letters = counts.sum(axis=0) + 1.0
            return np.log((counts + weight * letters / letters.sum()) / (counts.sum(axis=1, keepdims=True) + weight))

        if not random.sum() or not ordinary.sum():
            threshold = np.inf
        first = log_p(ordinary, 5.0)
        if further is not None:
            backoff = np.exp(first[None, :STATES, :])
            # what was seen once, as parts of a random string are, counts as unseen
            seen = np.maximum(further - DISCOUNT, 0.0)
            total = further.sum(axis=2, keepdims=True)
            further = np.log((seen + (BACKOFF + total - seen.sum(axis=2, keepdims=True)) * backoff) / (total + BACKOFF)).astype(np.float32)
        return MarkovModels(log_p(random, 50.0), first, threshold, further)

    def ratios(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, random over ordinary, of each span.

        A random string follows, with even odds, the chain learnt from samples, or
        draws from the classes of characters that it has (capitals, small letters,
        digits, marks) without memory, so that no alphabet is ruled out.
        """
        if not len(starts):
            return np.zeros(0)
        code = np.maximum(_CODE[raw], 0)

        def total(table: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0.0], np.cumsum(table[code[:-1], code[1:]])])
            return table[STATES, code[starts]] + upto[ends - 1] - upto[starts]

        size = np.zeros(len(starts))
        for k, n in enumerate(_CLASS_SIZE):
            upto = np.concatenate([[0], np.cumsum(_CLASS[code] == k)])
            size += n * (upto[ends] > upto[starts])
        random = np.logaddexp(total(self.random), -(ends - starts) * np.log(size)) - np.log(2)
        if self.further is None:
            return random - total(self.ordinary)
        later = self.further[code[:-2], code[1:-1], code[2:]].astype(float) if len(code) > 2 else np.zeros(0)
        upto = np.concatenate([[0.0], np.cumsum(later)])
        second = np.minimum(starts + 1, ends - 1)
        begun = self.ordinary[STATES, code[starts]] + np.where(ends - starts > 1, self.ordinary[code[starts], code[second]], 0.0)
        return random - begun - (upto[np.maximum(ends - 2, starts)] - upto[starts])


def random_spans(column: pa.Array, base: list[list[tuple[int, int, int]]], models: MarkovModels) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind, end) in code points of each row's runs above the threshold that touch none of its base spans."""
    raw, offsets = text_buffers(column)
    starts, ends, rows = runs_of(raw, offsets)
    high = models.ratios(raw, starts, ends) > models.threshold
    high[high] = [len(set(raw[a:b].tobytes())) >= RUN_DISTINCT for a, b in zip(starts[high], ends[high])]
    out: dict[int, list[tuple[int, int, int]]] = {}
    pad = ord(PAD)
    for a, b, r in zip(starts[high].tolist(), ends[high].tolist(), rows[high].tolist()):
        first, last = int(offsets[r]), int(offsets[r + 1])
        pads = 0
        while pads < PADS and b + pads < last and raw[b + pads] == pad:
            pads += 1
        x = int(np.count_nonzero((raw[first:a] & 0xC0) != 0x80))
        y = x + b + pads - a
        if not any(p < y and x < q for p, _, q in base[r]):
            out.setdefault(r, []).append((x, 3, y))
    return out


def fit_models(docs: DataFrame, sample_rows: int = 20_000, text_col: str = "text", id_col: str = "doc_id") -> MarkovModels:
    """Train both models and their threshold on a sample of about ``sample_rows`` documents.

    Labels come from the patterns: what they match is random; runs of 12 or more
    characters elsewhere in the same documents are ordinary. A quarter of the
    strings, by hash of string and text, is held out of the counts, in which
    ordinary strings stand in capitals too; for these a second-order chain is
    learnt (at most STATES cubed counts). The threshold is the ratio at which a
    run is FALSE_COST times likelier random than not, given the share of random
    runs among the held-out ones, which expectation maximisation finds (FEWEST at
    least). ``recall`` and ``found_share`` of the models are the shares of
    held-out random and other strings above the threshold. Rows
    are picked by hash of id and text, so the sample does not depend on
    partitions; all rows are taken while there are fewer. Only counts leave tasks.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    n = docs.count()
    ident = F.col(id_col).cast("string") if id_col in docs.columns else F.lit("")
    picked = docs.select(ident.alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if n > sample_rows:
        picked = picked.where(F.pmod(F.xxhash64(F.lit(3), "id", "text"), F.lit(n)) < sample_rows)
    sample = scratch.table(picked.select("text"), "sample")

    def labelled(batches):
        """Bytes, spans, held-out mark and label of the strings of a part of the texts."""
        for part in text_parts(batches, "text"):
            texts = part.column("text").to_pylist()
            spans = [base_spans(t) for t in texts]
            values = pa.array([v for t, s in zip(texts, spans) if s for v in secret_values(t)], pa.string())
            rest = pa.array([redact(t, s, " ") if s else t for t, s in zip(texts, spans)], pa.string())
            for label, column in ((0, values), (1, rest)):
                raw, offsets = text_buffers(column)
                a, b, row = runs_of(raw, offsets)
                whole = span_hashes(raw, offsets[:-1], offsets[1:])[row]
                yield label, raw, a, b, (span_hashes(raw, a, b) + whole) % np.uint64(4) == 0

    def count(batches):
        counts = np.zeros((2, STATES + 1, STATES))
        for label, raw, a, b, held in labelled(batches):
            counts[label] += transitions(raw, a[~held], b[~held])
            if label:
                counts[label] += transitions(_UPPER[raw], a[~held], b[~held])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "n": counts.ravel()[at]})

    def gather(run, shape) -> np.ndarray:
        out = np.zeros(shape)
        for r in sample.mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # one number a cell
            out.ravel()[r.i] = r.n
        return out

    def count_triples(batches):
        counts = np.zeros((STATES, STATES, STATES))
        for label, raw, a, b, held in labelled(batches):
            if label:
                counts += triples(raw, a[~held], b[~held]) + triples(_UPPER[raw], a[~held], b[~held])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "n": counts.ravel()[at]})

    counts = gather(count, (2, STATES + 1, STATES))
    models = MarkovModels.fit(counts[0], counts[1], 0.0, gather(count_triples, (STATES, STATES, STATES)))

    def judge(batches):
        seen = np.zeros((2, len(BINS)))
        for label, raw, a, b, held in labelled(batches):
            ratio = np.clip(models.ratios(raw, a[held], b[held]), BINS[0], BINS[-1])
            seen[label] += np.bincount(np.floor(ratio).astype(np.int64) - BINS[0], minlength=len(BINS))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "n": seen.ravel()[at]})

    if np.isfinite(models.threshold):
        seen = gather(judge, (2, len(BINS)))
        share, ratio = FEWEST, BINS + 0.5
        for _ in range(100):
            random = 1 / (1 + np.exp(-np.clip(ratio + np.log(share / (1 - share)), -500, 500)))
            share = float(np.clip((seen[1] * random).sum() / max(seen[1].sum(), 1), FEWEST, 0.5))
        threshold = float(np.ceil(np.log((1 - share) / share * FALSE_COST)))
        above = (seen * (BINS >= threshold)).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
        models = replace(models, threshold=threshold, recall=float(above[0]), found_share=float(above[1]))
    return models


def find_secrets(docs: DataFrame, models: MarkovModels | None = None, text_col: str = "text", redact_as: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``secret_spans``; with ``redact_as`` also ``redacted_text``.

    Spans are (start, kind, end) in code points of the whole text, by start, then
    kind as listed in KINDS. ``assign``, ``access`` and ``hex`` are whole matches
    of the base patterns, leftmost and non-overlapping in their kind; spans of
    different kinds may overlap. ``random`` are further runs of 12 or more
    characters (ALPHABET, and pad marks after them), 5 of them different, whose
    log-likelihood ratio, random over ordinary, exceeds the models' threshold;
    they never overlap base spans. Models are fitted on ``docs`` if none are given. ``redacted_text`` has
    each stretch covered by spans replaced by ``redact_as``; it is the text
    itself, null too, without spans.

    A null text counts as empty: no spans. Repeated rows are each searched; the
    result's own columns replace columns of these names. An empty table gives no rows.
    """
    models = models or fit_models(docs, text_col=text_col)
    keep = docs.drop("secret_spans", "redacted_text")
    out_schema = T.StructType([*keep.schema.fields, T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])))])
    if redact_as is not None:
        out_schema = out_schema.add("redacted_text", T.StringType())
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    names = [f.name for f in out_schema.fields]

    def run(batches):
        for part in text_parts(batches, text_col):
            column = part.column(part.schema.get_field_index(text_col))
            texts = column.to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            more = random_spans(column, base, models)
            found = [sorted(b + more.get(r, [])) for r, b in enumerate(base)]
            spans = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in f] for f in found]
            arrays = [*part.columns, pa.array(spans, arrow_spans)]
            if redact_as is not None:
                arrays.append(pa.array([redact(t, f, redact_as) if f else t for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return keep.mapInArrow(run, out_schema)


def redact_secrets(docs: DataFrame, models: MarkovModels | None = None, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with each secret in the text replaced by ``mark``."""
    found = find_secrets(docs, models, text_col, redact_as=mark)
    return found.select(*[F.col("redacted_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
