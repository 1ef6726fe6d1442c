"""Collocations of two and three words, from exact counts held in weighted acyclic automata."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.numbering import number_rows
from trialloom.llm.common import LOWER, Scratch, text_buffers, text_parts

#: Bytes of text and words that a shard counts at once; ids of its words take WORD_BITS bits.
SHARD_BYTES, SHARD_WORDS, WORD_BITS = 8 << 20, 1 << 20, 21
#: Characters of text for each prefix range, and for each sampled pair of words that ranges are cut by.
RANGE_CHARS, SAMPLE_CHARS = 16_000_000, 4096
#: Entries that a union holds before it sums them.
PENDING = 1_500_000

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Entries:
    """Phrases of one to three words as ids (0: no word) with weights, and the words that ids from 1 on stand for."""

    def __init__(self, words: pa.Array, ids: np.ndarray, weights: np.ndarray):
        self.words, self.ids, self.weights = words, ids, weights  # ids: (3, n)

    def select(self, keep: np.ndarray) -> Entries:
        """Some entries, with the words that they need."""
        ids = self.ids[:, keep]
        used = np.zeros(len(self.words) + 1, bool)
        used[ids] = True
        used[0] = False
        renumber = np.cumsum(used)
        renumber[~used] = 0
        return Entries(self.words.filter(pa.array(used[1:])), renumber[ids], self.weights[keep])


def sum_entries(parts: list[Entries]) -> Entries:
    """The union of entries: sorted by words, weights of equal phrases summed."""
    words = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[0] = 0
    rank[order + 1] = np.arange(1, len(order) + 1)
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, at = [], 0
    for p in parts:
        local = np.concatenate([[0], codes[at : at + len(p.words)] + 1])
        ids.append(rank[local[p.ids]])
        at += len(p.words)
    ids, weights = np.concatenate(ids, axis=1), np.concatenate([p.weights for p in parts])
    pair, at_pair = np.unique((ids[0] << 32) | ids[1], return_inverse=True)
    key = (at_pair << 32) | ids[2]
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    pair = pair[key[first] >> 32]
    summed = np.add.reduceat(weights[by], first) if len(first) else np.zeros(0, np.int64)
    return Entries(words.dictionary.take(pa.array(order)), np.stack([pair >> 32, pair & 0xFFFFFFFF, key[first] & 0xFFFFFFFF]), summed)


class Automaton:
    """A minimal acyclic automaton over words whose arcs carry the weights of the phrases that end with them.

    Levels are lists of arcs, ordered by state and label: of the root, of states
    after one word, of states after two. Phrases are given in sorted order, so a
    state is complete once the prefix changes; then it is registered, and states
    with the same arcs (labels, weights, targets) become one.
    """

    FIELDS = ("label0", "weight0", "target0", "start1", "label1", "weight1", "target1", "start2", "label2", "weight2")

    def __init__(self, words: pa.Array, arrays: dict[str, np.ndarray]):
        self.words = words
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: Entries) -> Automaton:
        """From entries in sorted order (as ``sum_entries`` gives them)."""
        a, b, c = entries.ids
        weights = entries.weights
        fresh1 = np.ones(len(a), bool)
        fresh1[1:] = a[1:] != a[:-1]
        fresh2 = fresh1.copy()
        fresh2[1:] |= b[1:] != b[:-1]
        fresh2 &= b > 0
        # arcs after two words, and the states that they leave
        third, second = np.flatnonzero(c > 0), np.flatnonzero(fresh2)
        state2 = np.searchsorted(second, third, side="right") - 1
        target1, start2, arcs2 = register(state2, len(second), c[third], weights[third], np.zeros(len(third), np.int64))
        # a pair's own weight stands first among its entries
        weight1 = np.where(c[second] == 0, weights[second], 0)
        first = np.flatnonzero(fresh1)
        state1 = np.searchsorted(first, second, side="right") - 1
        target0, start1, arcs1 = register(state1, len(first), b[second], weight1, target1)
        return cls(entries.words, {
            "label0": a[first], "weight0": np.where(b[first] == 0, weights[first], 0), "target0": target0,
            "start1": start1, "label1": b[second][arcs1], "weight1": weight1[arcs1], "target1": target1[arcs1],
            "start2": start2, "label2": c[third][arcs2], "weight2": weights[third][arcs2],
        })

    def entries(self) -> Entries:
        """All phrases with a weight, in no order."""
        n1 = np.diff(self.start1)[self.target0]
        arc1 = _ranges(self.start1[self.target0], n1)
        a1, b1 = np.repeat(self.label0, n1), self.label1[arc1]
        n2 = np.diff(self.start2)[self.target1[arc1]]
        arc2 = _ranges(self.start2[self.target1[arc1]], n2)
        ids = np.zeros((3, len(self.label0) + len(arc1) + len(arc2)), np.int64)
        ids[0] = np.concatenate([self.label0, a1, np.repeat(a1, n2)])
        ids[1, len(self.label0) :] = np.concatenate([b1, np.repeat(b1, n2)])
        ids[2, len(self.label0) + len(arc1) :] = self.label2[arc2]
        weights = np.concatenate([self.weight0, self.weight1[arc1], self.weight2[arc2]]).astype(np.int64)
        have = weights > 0
        return Entries(self.words, ids[:, have], weights[have])

    def compose(self, asked: Entries) -> np.ndarray:
        """The weight of each asked phrase, 0 if it has none: both automata are walked word by word together."""
        known = pc.index_in(asked.words, value_set=self.words)
        known = np.concatenate([[0], pc.add(known, 1).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)])
        a, b, c = known[asked.ids]
        at, ok = _find(self.label0.astype(np.int64), a)
        out = np.where(ok & (b == 0), _take(self.weight0, at), 0)
        state = _take(self.target0, at)
        at, found = _find((_owners(self.start1) << 32) | self.label1, (state << 32) | np.maximum(b, 0))
        ok &= found & (b > 0)
        out = np.where(ok & (c == 0), _take(self.weight1, at), out)
        state = _take(self.target1, at)
        at, found = _find((_owners(self.start2) << 32) | self.label2, (state << 32) | np.maximum(c, 0))
        return np.where(ok & found & (c > 0), _take(self.weight2, at), out)

    def pack(self) -> bytes:
        sizes = np.array([pc.binary_length(self.words).to_numpy(zero_copy_only=False)] if len(self.words) else [[]], np.int64)[0]
        parts = [sizes, *[getattr(self, f) for f in self.FIELDS]]
        head, body = [], []
        for x in parts:
            kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
            head += [len(x), kind.itemsize]
            body.append(x.astype(kind).tobytes())
        raw = np.array(head, np.int64).tobytes() + b"".join(body) + b"".join(self.words.to_pylist())
        return zstandard.compress(raw, 3)

    @classmethod
    def unpack(cls, blob: bytes) -> Automaton:
        raw = zstandard.decompress(blob)
        head = np.frombuffer(raw, np.int64, 2 * (len(cls.FIELDS) + 1))
        at, parts = head.nbytes, []
        for n, size in head.reshape(-1, 2):
            parts.append(np.frombuffer(raw, np.dtype(f"u{size}"), n, at).astype(np.int64))
            at += n * size
        offsets = np.concatenate([[0], np.cumsum(parts[0])]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(parts[0]), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at:])])
        return cls(words, dict(zip(cls.FIELDS, parts[1:])))


def register(state: np.ndarray, n: int, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states with equal arcs: (number of each state's representative, arc starts of the representatives, their arcs).

    ``state`` is the ascending state of each arc. States are compared by a hash of
    their arcs first, then arc by arc."""
    size = np.bincount(state, minlength=n).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        h = (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (target.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        total = (upto[start[1:]] - upto[start[:-1]]) + size.astype(np.uint64)
    _, first, group = np.unique(total, return_index=True, return_inverse=True)
    like = first[group] if n else np.zeros(0, np.int64)
    # states of one hash that differ from its first state stay alone
    same = size == size[like]
    of = np.flatnonzero(same & (like != np.arange(n)))
    mine, theirs = _ranges(start[of], size[of]), _ranges(start[like[of]], size[of])
    differs = (label[mine] != label[theirs]) | (weight[mine] != weight[theirs]) | (target[mine] != target[theirs])
    same[np.repeat(of, size[of])[differs]] = False
    like = np.where(same, like, np.arange(n))
    kept = np.flatnonzero(like == np.arange(n))
    number = np.zeros(n, np.int64)
    number[kept] = np.arange(len(kept))
    return number[like], np.concatenate([[0], np.cumsum(size[kept])]), _ranges(start[kept], size[kept])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the ranges."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _owners(start: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(start) - 1), np.diff(start))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return at, keys[at] == x if len(keys) else np.zeros(len(x), bool)


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(values) else np.zeros(len(at), np.int64)


# ---------------------------------------------------------------- counting of shards


def count_phrases(texts: pa.Array) -> Iterator[Entries]:
    """Phrases of one to three words within pieces of the texts, with counts, in sorted order, for runs of SHARD_WORDS words."""
    raw, offsets = text_buffers(texts)
    raw = LOWER[raw]
    breaks = _BREAK[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~(_SPACE[raw] | breaks)
    before = np.concatenate([[False], inside[:-1]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    sizes = np.flatnonzero(before & (~inside | edge)) - starts
    # words of one piece: no break and no edge of a text in between
    edge[:-1] |= breaks
    piece = np.cumsum(edge, dtype=np.int32)[starts]
    data = raw[inside[:-1]]
    del inside, before, edge, breaks, starts
    upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for s in range(0, len(sizes), SHARD_WORDS):
        end = min(s + SHARD_WORDS + 2, len(sizes))
        words = pa.Array.from_buffers(pa.large_binary(), end - s, [None, pa.py_buffer(upto[s : end + 1] - upto[s]), pa.py_buffer(data[upto[s] : upto[end]])]).dictionary_encode()
        order = pc.array_sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        ids = rank[words.indices.to_numpy()]
        n = min(SHARD_WORDS, len(sizes) - s)  # phrases that start in this run
        two = np.flatnonzero(piece[s + 1 : end][:n] == piece[s : s + n][: end - s - 1])
        three = np.flatnonzero(piece[s + 2 : end][:n] == piece[s : s + n][: max(0, end - s - 2)])
        one = ids[:n] << 2 * WORD_BITS
        pairs = one[two] | (ids[two + 1] << WORD_BITS)
        triples = one[three] | (ids[three + 1] << WORD_BITS) | ids[three + 2]
        keys = np.concatenate([one, pairs, triples])
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        mask = (1 << WORD_BITS) - 1
        yield Entries(words.dictionary.take(pa.array(order)), np.stack([keys >> 2 * WORD_BITS, (keys >> WORD_BITS) & mask, keys & mask]), counts)


def cut_entries(entries: Entries, lang: bytes, splitters: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, Entries]]:
    """The part of sorted entries in each prefix range: a phrase is in the range with as many splitters at or below (lang, first word, second word)."""
    base = bisect.bisect_left(splitters, (lang,))
    words = entries.words.to_pylist()
    keys = (entries.ids[0] << 32) | entries.ids[1]
    edges = [0]
    for _, a, b in splitters[base : bisect.bisect_left(splitters, (lang + b"\0",))]:
        i = bisect.bisect_left(words, a)
        j = bisect.bisect_left(words, b) + 1 if b and i < len(words) and words[i] == a else 0
        edges.append(int(np.searchsorted(keys, ((i + 1) << 32) | j)))
    edges.append(len(keys))
    for k, (x, y) in enumerate(zip(edges, edges[1:])):
        if y > x:
            yield base + k, entries.select(np.arange(x, y))


def range_of(splitters: list[tuple[bytes, bytes, bytes]], key: tuple[bytes, bytes, bytes]) -> int:
    return bisect.bisect_right(splitters, key)


def prefix_splitters(docs: DataFrame) -> list[tuple[bytes, bytes, bytes]]:
    """(lang, word, word) triples that cut phrases into ranges of about RANGE_CHARS of text.

    They are quantiles of the word pairs that stand at every SAMPLE_CHARS
    characters of all texts. The driver gets one triple a range. Results do not
    depend on where ranges are cut."""
    length = F.char_length("text")
    total = docs.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    ranges = total // RANGE_CHARS + 1
    if ranges == 1:
        return []
    window = F.explode(F.transform(F.sequence(F.lit(0), F.floor(length / SAMPLE_CHARS).cast("int")), lambda i: F.substring(F.col("text"), i * SAMPLE_CHARS + 1, F.lit(200))))
    lower = F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("lang", window.alias("w")).select("lang", F.regexp_extract_all(lower, F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"), F.lit(0)).alias("w"))
    pairs = words.where(F.size("w") > 3).select("lang", F.col("w")[1].alias("a"), F.col("w")[2].alias("b"))
    placed = number_rows(pairs, "place", "lang", "a", "b")
    step = F.lit(max(1, placed.count() // ranges))
    cut = placed.where(F.col("place") % step == 0).select("lang", "a", "b").distinct().collect()
    return sorted((r.lang.encode(), r.a.encode(), r.b.encode()) for r in cut)


# ---------------------------------------------------------------- requests between ranges


def requests(automaton: Automaton, lang: bytes, splitters: list) -> tuple[Entries, dict[int, Entries]]:
    """A range's phrases in sorted order, and the parts whose counts it needs, by the range that holds them.

    Parts are the single words of candidates, and the last two words of three;
    these carry the greatest count of a phrase that they end, plus 1; words carry 1."""
    own = sum_entries([automaton.entries()])
    a, b, c = own.ids
    two, three = (b > 0) & (c == 0), c > 0
    need = np.concatenate([a[two | three], b[two], c[three]])
    ends = np.stack([b[three], c[three]])
    ids = np.zeros((3, len(need) + ends.shape[1]), np.int64)
    ids[0] = np.concatenate([need, ends[0]])
    ids[1, len(need) :] = ends[1]
    weights = np.concatenate([np.ones(len(need), np.int64), own.weights[three] + 1])
    # the greatest weight of equal parts
    by = np.lexsort((-weights, ids[1], ids[0]))
    ids, weights = ids[:, by], weights[by]
    fresh = np.ones(len(weights), bool)
    fresh[1:] = (ids[:2, 1:] != ids[:2, :-1]).any(axis=0)
    asked = Entries(own.words, ids[:, fresh], weights[fresh])
    words = own.words.to_pylist()
    owner = np.array([range_of(splitters, (lang, words[i - 1], words[j - 1] if j else b"")) for i, j, _ in asked.ids.T], np.int64)
    return own, {int(o): asked.select(np.flatnonzero(owner == o)) for o in np.unique(owner)}


def _scores(own: Entries, parts: dict[tuple[int, int], int], ended: np.ndarray, share: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(phrase, a, l, r, score) of a range's candidates; ``ended``: the greatest count of a phrase that each entry ends."""
    a, b, c = own.ids
    pair_count = {(i, j): int(w) for i, j, k, w in zip(a, b, c, own.weights) if j and not k}
    begun: dict[tuple[int, int], int] = {}
    for i, j, k, w in zip(a, b, c, own.weights):
        if k:
            begun[i, j] = max(begun.get((i, j), 0), int(w))
    words = own.words.to_pylist()
    for i, j, k, w, longer in zip(*own.ids.tolist(), own.weights.tolist(), ended.tolist()):
        if not j:
            continue
        if not k and 100 * max(longer, begun.get((i, j), 0)) >= share * w:
            continue
        cuts = [(parts[i, 0], parts[j, 0])] if not k else [(parts[i, 0], parts[j, k]), (pair_count[i, j], parts[k, 0])]
        score, _, left, right = min((1_000_000 * w * w // (x * y), n, x, y) for n, (x, y) in enumerate(cuts))
        yield b" ".join(words[x - 1] for x in (i, j, k) if x).decode(), w, left, right, score


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut at ``[.,;:!?]`` and line breaks into pieces,
    and these at spaces and tabs into words. n counts a language's words, f(phrase)
    a phrase's occurrences within pieces. Candidates are phrases of two or three
    words with a = f >= ``least``; cut into a first part (l) and a rest (r) they
    score floor(1000000 a a / (l r)), the lowest-scoring cut counts, then the
    earliest. A candidate of two words goes if a candidate of three that holds it
    has at least ``share`` per cent of its count. All counts are exact.

    Runs of words are counted as sorted phrases, each run's in an automaton a
    prefix range; a range's automata are united and their weights summed; what
    has fewer than ``least`` occurrences goes, as no part of a candidate can.
    Counts of parts come from composing a range's requests with the automaton
    of the range that holds them. A range holds a bounded share of the text,
    however often a word occurs: it is cut by the first two words, and repeats
    within a run are one entry.

    Null text: empty. Null lang: ``und``. Repeated rows count as often as they
    occur. Other columns take no part. A language without candidates, and an
    empty table, give no rows. Ties: higher a, then the lesser phrase by bytes.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    splitters = prefix_splitters(docs)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches, "text", rows=1 << 20, size=SHARD_BYTES):
            langs = part.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = part.column("text").filter(pc.equal(langs.indices, k))
                for entries in count_phrases(texts):
                    for at, piece in cut_entries(entries, lang.encode(), splitters):
                        yield pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "lang": [lang], "automaton": pa.array([Automaton.build(piece).pack()], pa.binary())})

    counted = docs.mapInArrow(shards, "range int, lang string, automaton binary")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            whole = sum_entries(held)
            words = int(whole.weights[whole.ids[1] == 0].sum())
            kept = Automaton.build(whole.select(np.flatnonzero(whole.weights >= least)))
            return pa.RecordBatch.from_pydict({"range": pa.array([key[0]], pa.int32()), "lang": [key[1]], "words": pa.array([words], pa.int64()), "automaton": pa.array([kept.pack()], pa.binary())})

        key, held, pending = None, [], 0
        for at, lang, blob in _rows(batches, "range", "lang", "automaton"):
            if (at, lang) != key and key is not None:
                yield done()
                held, pending = [], 0
            key = (at, lang)
            held.append(Automaton.unpack(blob).entries())
            pending += len(held[-1].weights)
            if pending > PENDING and len(held) > 1:
                held = [sum_entries(held)]
                pending = 0  # what is summed counts no more, so sums come each PENDING new entries
        if key is not None:
            yield done()

    dealt = counted.repartition("range", "lang").sortWithinPartitions("range", "lang")
    united = scratch.table(dealt.mapInArrow(unite, "range int, lang string, words long, automaton binary"), "united")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, lang, blob in _rows(batches, "range", "lang", "automaton"):
            _, asked = requests(Automaton.unpack(blob), lang.encode(), splitters)
            for owner, parts in asked.items():
                yield pa.RecordBatch.from_pydict({"range": pa.array([owner], pa.int32()), "lang": [lang], "asker": pa.array([at], pa.int32()), "automaton": pa.array([Automaton.build(parts).pack()], pa.binary())})

    asked = united.select("range", "lang", "automaton").mapInArrow(ask, "range int, lang string, asker int, automaton binary")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(asker: int, owner: int, numbers: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"range": pa.array([asker], pa.int32()), "lang": [lang], "owner": pa.array([owner], pa.int32()), "counts": pa.array([numbers.tolist()], pa.list_(pa.int64()))})

        key, held, own, ended = None, None, None, None
        for at, lang_, asker, blob in _rows(batches, "range", "lang", "asker", "automaton"):
            if (at, lang_) != key:
                if key is not None:
                    yield row(key[0], -1, ended)
                key, lang, held = (at, lang_), lang_, Automaton.unpack(blob)  # the range's own row stands first
                own = sum_entries([held.entries()])
                ended = np.zeros(len(own.weights), np.int64)
                continue
            parts = sum_entries([Automaton.unpack(blob).entries()])
            yield row(asker, at, held.compose(parts))
            # phrases of three words that end with phrases of this range
            ended = np.maximum(ended, np.maximum(Automaton.build(parts).compose(own) - 1, 0))
        if key is not None:
            yield row(key[0], -1, ended)

    posed = united.select("range", "lang", F.lit(-1).alias("asker"), "automaton").unionByName(asked)
    answers = posed.repartition("range", "lang").sortWithinPartitions("range", "lang", "asker").mapInArrow(answer, "range int, lang string, owner int, counts array<long>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            found = list(_scores(own, parts, ended, share))
            for s in range(0, len(found), 10_000):
                columns = list(zip(*found[s : s + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(columns[0])), pa.array(columns[0]), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["lang", "phrase", "a", "l", "r", "score"])

        key, own, wanted, parts, ended = None, None, None, {}, None
        for at, lang, owner, blob, counts in _rows(batches, "range", "lang", "owner", "automaton", "counts"):
            if (at, lang) != key:
                if key is not None:
                    yield from done()
                key, parts = (at, lang), {}
                own, wanted = requests(Automaton.unpack(blob), lang.encode(), splitters)
                index = {w: i + 1 for i, w in enumerate(own.words.to_pylist())}
            elif owner < 0:
                ended = np.array(counts, np.int64)
            else:
                asked = sum_entries([wanted[owner]])
                own_ids = np.array([0, *[index[w] for w in asked.words.to_pylist()]])
                parts.update(zip(zip(*own_ids[asked.ids[:2]].tolist()), counts))
        if key is not None:
            yield from done()

    whole = united.select("range", "lang", F.lit(-2).alias("owner"), "automaton", F.lit(None).cast("array<long>").alias("counts"))
    told = whole.unionByName(answers.withColumn("automaton", F.lit(None).cast("binary")))
    scored = told.repartition("range", "lang").sortWithinPartitions("range", "lang", "owner").mapInArrow(score, "lang string, phrase string, a long, l long, r long, score long")

    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    words = united.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Values of the named columns, row by row, one row's at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)
