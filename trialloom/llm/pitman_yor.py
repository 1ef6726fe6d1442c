"""Language-model scores from a hierarchical Pitman-Yor model of words."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import LOWER, Scratch, mix64, span_hashes, text_buffers, text_parts, uniform, word_spans

#: Words' numbers begin with their last two bytes, which choose the parent restaurant, and, from 1 GB of text on, some bits of
#: their hash: there is such a beginning for so many bytes of text, rounded up to a power of two within these bits.
CONTEXT_BYTES, LEAST_BITS, MOST_BITS = 16 << 10, 12, 22
PARENT_BITS = 16
PARENTS = 1 << PARENT_BITS
#: A number goes on with the bucket that gave it and the word's rank among all of that bucket that begin alike. A bucket's
#: 8 MB of text hold less than 2**22 words.
BUCKET_BITS, RANK_BITS = 18, 22
MOST_BUCKETS = 1 << BUCKET_BITS
BLOCK_TOKENS = 1_500_000
BUCKET_BYTES = 8 << 20
#: Groups are exchanged to one task for so many bytes of text.
TASK_BYTES = 16 << 20
#: Contexts' totals are summed in one group for so many bytes of text.
SHARD_BYTES = 32 << 20
#: Dishes with at most so many customers get tables from their exact conditional.
EXACT_CUSTOMERS = 32
STRENGTH = 1.0
#: Keys of what stands before a text and of its end. No word ends with two spaces.
START_KEY = np.uint64(0x2020 << 48)
END_KEY = np.uint64((0x2020 << 48) + 1)
#: A word with at least this share of the tokens is frequent: its entries are dealt to buckets by parent restaurant.
FREQUENT_SHARE = 1 / 2000


@dataclass(frozen=True)
class Layout:
    """How words are numbered and dealt: bits of a number's beginning, sorted numbers of frequent words, buckets and shards."""

    bits: int
    frequent: np.ndarray
    buckets: int = 1
    shards: int = 1

    @staticmethod
    def bits_for(size: int) -> int:
        return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(size, 1) / CONTEXT_BYTES))))

    @property
    def contexts(self) -> int:
        return 1 << self.bits

    @property
    def below(self) -> int:
        """Bits of a hash in a number's beginning, after the parent's."""
        return max(self.bits - PARENT_BITS, 0)

    def parent(self, numbers: np.ndarray) -> np.ndarray:
        return numbers >> (BUCKET_BITS + RANK_BITS + self.below)

    def home(self, numbers: np.ndarray) -> np.ndarray:
        """The bucket that numbered a word."""
        return (numbers >> RANK_BITS) & (MOST_BUCKETS - 1)

    def shard(self, buckets):
        """The shard that sums up the contexts numbered in a bucket."""
        return buckets * self.shards // self.buckets


def _pack(a: np.ndarray) -> bytes:
    """An integer or float array as byte planes, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def _ints(data: bytes) -> np.ndarray:
    return _unpack(data, np.uint32).astype(np.int64)


def _pack_ints(a: np.ndarray) -> bytes:
    return _pack(a.astype(np.uint32))


def _joined(arrays: list, dtype=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *arrays])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of every token; each row ends with an end token.

    A word's key is its last two bytes (a space before a single one) and 48 bits of its hash.
    """
    raw, offsets = text_buffers(column)
    raw = LOWER[raw]
    starts, ends, row = word_spans(raw, offsets)
    n = len(offsets) - 1
    h = span_hashes(raw, starts, ends) >> np.uint64(16)
    if len(ends):
        before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0x20).astype(np.uint64)
        h |= (before << np.uint64(56)) | (raw[ends - 1].astype(np.uint64) << np.uint64(48))
    counts = np.bincount(row, minlength=n)[:n]
    word = np.full(len(h) + n, END_KEY)
    word[np.arange(len(h)) + row] = h  # one end token for each earlier row
    return word, np.repeat(np.arange(n), counts + 1)


def _buckets(words: np.ndarray, contexts: np.ndarray, layout: Layout) -> np.ndarray:
    """Bucket of each entry: that which numbered the word, of frequent words by a hash of word and parent restaurant."""
    _, dealt = _find(layout.frequent, words, True)
    parent = layout.parent(contexts).astype(np.uint64)
    h = mix64(words.astype(np.uint64) + (parent + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(dealt, ((h >> np.uint64(32)) * np.uint64(layout.buckets) >> np.uint64(32)).astype(np.int64), layout.home(words))


def _by_use(uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by falling use, and each word's place there."""
    order = np.argsort(-uses, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return order, place


BLOCKS = "block long, bucket int, ids array<{id}>, train binary, lengths binary, stream binary, uses binary, start int, keys binary, held binary, counts binary"


def make_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of documents (doc_id, text, train), as streams of words.

    A block is one row with bucket -1: its documents' lengths, and for each
    token the rank of its word by use in the block. It also has a row for each
    bucket of words: their keys, and counts in training and other text. Words are
    placed by bucket and key.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def close(parts, task, number):
        word, row = (np.concatenate(x) for x in zip(*[p[:2] for p in parts]))
        ids, train = pa.concat_arrays([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        block = (task << 24) | number
        distinct, local = np.unique(np.append(word, START_KEY), return_inverse=True)
        home = ((mix64(distinct) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        distinct, home, local = distinct[order], home[order], place[local]
        start, local = int(local[-1]), local[:-1]
        uses = np.bincount(local, minlength=len(distinct))
        counts = np.bincount(local, train[row], len(distinct)).astype(np.int64)
        uses[start], counts[start] = len(train), train.sum()
        none = {k: None for k in ("ids", "train", "lengths", "stream", "uses", "start", "keys", "held", "counts")}
        out = [none | {"block": block, "bucket": -1, "ids": ids, "train": _pack(train.astype(np.uint8)), "lengths": _pack_ints(np.bincount(row, minlength=len(train))), "stream": _pack_ints(_by_use(uses)[1][local]), "uses": _pack_ints(uses), "start": start}]
        edges = np.searchsorted(home, np.arange(buckets + 1))
        for b in range(buckets):
            e = slice(edges[b], edges[b + 1])
            if edges[b] < edges[b + 1]:
                out.append(none | {"block": block, "bucket": b, "keys": _pack(distinct[e]), "held": _pack_ints((uses - counts)[e]), "counts": _pack_ints(counts[e])})
        return out

    def run(batches):
        task, number, parts, held = TaskContext.get().partitionId(), 0, [], 0
        schema = None

        def batch_of(rows):
            arrays = []
            for f in schema:
                values = [r[f.name] for r in rows]
                if f.name == "ids":
                    ends = np.cumsum([0] + [0 if v is None else len(v) for v in values]).astype(np.int32)
                    full = [v for v in values if v is not None]
                    flat = pa.concat_arrays(full) if full else pa.array([], f.type.value_type)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                else:
                    arrays.append(pa.array(values, f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(id_type)), *[(k, pa.binary()) for k in ("train", "lengths", "stream", "uses")], ("start", pa.int32()), *[(k, pa.binary()) for k in ("keys", "held", "counts")]])
            for part in text_parts([batch], "text"):
                word, row = tokens(part.column("text"))
                before = sum(len(p[3]) for p in parts)
                parts.append((word, row + before, part.column("doc_id"), part.column("train").to_numpy(zero_copy_only=False).astype(bool)))
                held += len(word)
                if held >= BLOCK_TOKENS:
                    yield batch_of(close(parts, task, number))
                    number, parts, held = number + 1, [], 0
        if parts:
            yield batch_of(close(parts, task, number))

    return docs.mapInArrow(run, BLOCKS.format(id=kind))


NAMES = "block long, bucket int, numbers binary, counts binary, uses long, trained long"


def number_words(blocks: DataFrame, layout: Layout, tasks: int) -> DataFrame:
    """Number and training count of each word of each block, in the block's order.

    A number is the key's beginning, the bucket, and the rank by frequency among the
    bucket's words that begin so: no two words share one. A row with block -1 holds the bucket's numbers of words that may be frequent,
    their uses in all text as counts, and the uses of all its words in all and in training text.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        keys = [_unpack(x.as_py(), np.uint64) for x in group["keys"]]
        count = [_ints(x.as_py()) for x in group["counts"]]
        distinct, local = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(local, np.concatenate(count), len(distinct)).astype(np.int64)
        uses = counts + np.bincount(local, np.concatenate([_ints(x.as_py()) for x in group["held"]]), len(distinct)).astype(np.int64)
        slot = (distinct >> np.uint64(48 - layout.below)).astype(np.int64)
        order = np.lexsort((distinct, -uses, slot))
        ordered = slot[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        if rank.max() >> RANK_BITS:
            raise ValueError("too many words in a bucket")
        number = (((slot << BUCKET_BITS) | bucket) << RANK_BITS) | rank
        words = distinct != START_KEY
        total = int(uses[words].sum())
        often = words & (uses >= max(1, total * FREQUENT_SHARE))
        out = [{"block": -1, "bucket": bucket, "numbers": _pack(number[often]), "counts": _pack(uses[often]), "uses": total, "trained": int(counts[words].sum())}]
        edges = np.cumsum([0, *map(len, keys)])
        for r, block in enumerate(group["block"]):
            mine = local[edges[r] : edges[r + 1]]
            out.append({"block": block.as_py(), "bucket": bucket, "numbers": _pack(number[mine]), "counts": _pack(counts[mine]), "uses": None, "trained": None})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("counts", pa.binary()), ("uses", pa.int64()), ("trained", pa.int64())]))

    return blocks.where("part = 'words'").select("block", "bucket", "keys", "held", "counts").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, NAMES)


def frequent_words(names: DataFrame) -> tuple[np.ndarray, int]:
    """Sorted numbers of the words with a large share of the tokens, 1 / FREQUENT_SHARE at most, and the number of training tokens.

    The words only decide where entries are held."""
    rows = names.where("block = -1")
    uses, trained = rows.agg(F.coalesce(F.sum("uses"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    least = max(1, uses * FREQUENT_SHARE)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number, n = _unpack(row["numbers"], np.int64), _unpack(row["counts"], np.int64)
                yield pa.RecordBatch.from_pydict({"n": number[n >= least]})

    found = rows.select("numbers", "counts").mapInArrow(run, "n long").toArrow()["n"].to_numpy()
    return np.sort(found.astype(np.int64)), trained


class Block:
    """A block's tokens as entries (word, context), sorted by bucket, word and context."""

    def __init__(self, rows: pa.Table, layout: Layout):
        rows = rows.take(np.argsort(rows["bucket"].to_numpy(), kind="stable"))
        body, names = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        self.block = body["block"]
        self.homes = names["bucket"].to_pylist()
        self.numbers = np.concatenate([_unpack(x.as_py(), np.int64) for x in names["numbers"]])
        self.counts = np.concatenate([_unpack(x.as_py(), np.int64) for x in names["counts"]])
        self.train, self.lengths = _unpack(body["train"], np.uint8).astype(bool), _ints(body["lengths"])
        self.stream = _by_use(_ints(body["uses"]))[0][_ints(body["stream"])]
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = body["start"]
        order = np.argsort(self.numbers)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        key, entry = np.unique((rank[self.stream] << 32) | rank[before], return_inverse=True)
        self.word, self.context = order[key >> 32], order[key & 0xFFFFFFFF]  # places among the block's words
        place = _buckets(self.numbers[self.word], self.numbers[self.context], layout)
        order = np.argsort(place, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.word, self.context, self.place, self.entry = self.word[order], self.context[order], place[order], rank[entry]
        self.edges = np.searchsorted(self.place, np.arange(layout.buckets + 1))


ASKS = "block long, bucket int, words binary, sizes binary, contexts binary, counts binary"


def ask(blocks: DataFrame, names: DataFrame, layout: Layout, tasks: int) -> DataFrame:
    """A row for each block and bucket: its entries' words, how many contexts each has, the contexts, and training counts."""

    def run(rows: pa.Table) -> pa.Table:
        b = Block(rows, layout)
        trained = np.bincount(b.entry, np.repeat(b.train, b.lengths), len(b.word)).astype(np.uint32)
        words, contexts = b.numbers[b.word], b.numbers[b.context]
        out = []
        for k in np.unique(b.place):
            e = slice(b.edges[k], b.edges[k + 1])
            own, sizes = np.unique(words[e], return_counts=True)
            out.append({"block": b.block, "bucket": int(k), "words": _pack(own), "sizes": _pack_ints(sizes), "contexts": _pack(contexts[e]), "counts": _pack(trained[e])})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("words", "sizes", "contexts", "counts")]]))

    bodies = blocks.where("part = 'body'").select("block", "bucket", "train", "lengths", "stream", "uses", "start")
    named = names.where("block >= 0").select("block", "bucket", "numbers", "counts")
    both = bodies.unionByName(named, allowMissingColumns=True)
    return both.repartition(tasks, "block").groupBy("block").applyInArrow(run, ASKS)


STATE = "bucket int, words binary, sizes binary, contexts binary, customers binary, tables binary, parent_tables binary, root_tables binary, dishes binary, samples array<binary>"


def merge_counts(asks: DataFrame, layout: Layout, tasks: int) -> DataFrame:
    """One row a bucket: its words with training counts by context, all tables at one a dish."""

    def run(group: pa.Table) -> pa.Table:
        words, contexts, counts = [], [], []
        for r in range(len(group)):
            w, size = _unpack(group["words"][r].as_py(), np.int64), _ints(group["sizes"][r].as_py())
            n = _unpack(group["counts"][r].as_py(), np.uint32)
            seen = n > 0
            words.append(np.repeat(w, size)[seen])
            contexts.append(_unpack(group["contexts"][r].as_py(), np.int64)[seen])
            counts.append(n[seen])
        n = np.concatenate(counts)
        distinct, local = np.unique(np.concatenate(words), return_inverse=True)
        places, place = np.unique(np.concatenate(contexts), return_inverse=True)
        key, entry = np.unique((local << 32) | place, return_inverse=True)
        customers = np.bincount(entry, n, len(key)).astype(np.uint32)
        owner, context = key >> 32, places[key & 0xFFFFFFFF]
        groups = int(_changes(owner, layout.parent(context)).sum())
        one = lambda k: _pack(np.ones(k, np.uint32))
        sizes = np.bincount(owner, minlength=len(distinct))
        row = {"bucket": group["bucket"][0].as_py(), "words": _pack(distinct), "sizes": _pack_ints(sizes), "contexts": _pack(context), "customers": _pack(customers), "tables": one(len(key)), "parent_tables": one(groups), "root_tables": one(len(distinct)), "dishes": None, "samples": []}
        return pa.Table.from_pylist([row], _STATE_SCHEMA)

    return asks.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, STATE)


_STATE_SCHEMA = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("words", "sizes", "contexts", "customers", "tables", "parent_tables", "root_tables", "dishes")], ("samples", pa.list_(pa.binary()))])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


class Seating:
    """A bucket's dishes at the three levels. Root dishes of frequent words are held by ``Totals``: their parents are in many buckets."""

    def __init__(self, row: dict, layout: Layout):
        self.row = row
        self.words = _unpack(row["words"], np.int64)
        self.sizes = _unpack(row["sizes"], np.uint32)
        self.contexts = _unpack(row["contexts"], np.int64)
        self.customers, self.tables, self.parent_tables, self.root_tables = (_ints(row[k]) for k in ("customers", "tables", "parent_tables", "root_tables"))
        self.owner = np.repeat(np.arange(len(self.words)), self.sizes)
        self.slot, self.dealt = _find(layout.frequent, self.words, True)
        self.layout = layout
        # dishes of parents: (word, parent), in the order of entries
        parent = layout.parent(self.contexts)
        new = _changes(parent, self.owner)
        self.group = np.cumsum(new) - 1
        self.parents, self.group_owner = parent[new], self.owner[new]

    @cached_property
    def _numbered(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.contexts, return_inverse=True)

    @property
    def places(self) -> np.ndarray:
        """Sorted numbers of the bucket's contexts."""
        return self._numbered[0]

    @property
    def context(self) -> np.ndarray:
        """Place of each entry's context among them."""
        return self._numbered[1]

    @cached_property
    def drawn(self) -> np.ndarray:
        """Entries with more than one customer; all others have one table."""
        return np.flatnonzero(self.customers > 1)

    @cached_property
    def asked(self) -> np.ndarray:
        """Places of the contexts whose totals draws need, by shard."""
        at = np.unique(self.context[self.drawn])
        return at[np.argsort(self.layout.shard(self.layout.home(self.places[at])), kind="stable")]

    def set_sample(self, s: int) -> None:
        both = _ints(self.row["samples"][s])
        a, b = len(self.contexts), len(self.contexts) + len(self.parents)
        self.tables, self.parent_tables, self.root_tables = both[:a], both[a:b], both[b:]

    @property
    def parent_customers(self) -> np.ndarray:
        return np.bincount(self.group, self.tables, len(self.parents)).astype(np.int64)

    @property
    def root_customers(self) -> np.ndarray:
        return np.bincount(self.group_owner, self.parent_tables, len(self.words)).astype(np.int64)

    def partial_totals(self) -> np.ndarray:
        """Flat sums: customers and tables of parents and of the root; counts of dishes with one and two customers at
        each level; words; frequent words' root customers, which the sums before leave out of the root."""
        sums = [np.bincount(self.parents, x, PARENTS) for x in (self.parent_customers, self.parent_tables)]
        own = ~self.dealt
        root, tables = self.root_customers[own], self.root_tables[own]
        once = [[(x == 1).sum(), (x == 2).sum()] for x in (self.customers, self.parent_customers, root)]
        shared = np.bincount(self.slot[self.dealt], self.root_customers[self.dealt], len(self.layout.frequent))
        return np.concatenate([*sums, [root.sum(), tables.sum()], np.ravel(once), [own.sum()], shared]).astype(float)


@dataclass(frozen=True)
class Totals:
    """What restaurants hold over all buckets, with each level's discount; of contexts, those that a task is at work on."""

    flat: np.ndarray
    discounts: tuple[float, float, float]
    layout: Layout  # and what its frequent words have at the root
    root_customers: np.ndarray
    root_tables: np.ndarray
    counts: np.ndarray | None = None

    @staticmethod
    def size(layout: Layout, contexts: int | None = None) -> int:
        return 2 * (layout.contexts if contexts is None else contexts) + 2 * PARENTS + 2 + 6 + 1 + len(layout.frequent)

    @staticmethod
    def of(sums: np.ndarray, layout: Layout, before: Totals | None, number: int) -> Totals:
        """From the sums over buckets, with the frequent words' root tables drawn anew, given the totals before."""
        frequent = layout.frequent
        cut = len(sums) - len(frequent)
        flat, customers = sums[:cut].copy(), sums[cut:].astype(np.int64)
        tables = (customers > 0).astype(np.int64)
        if before is not None:
            seen = np.flatnonzero(customers)
            c = customers[seen]
            old = np.minimum(before.root_tables[seen], c)
            tables[seen] = draw_root_tables(frequent[seen], c, old, before, number)
        flat[-1] += (customers > 0).sum()
        at = 2 * PARENTS
        flat[at : at + 2] += customers.sum(), tables.sum()
        flat[-3:-1] += (customers == 1).sum(), (customers == 2).sum()
        return Totals(flat, before.discounts if before is not None else Totals.estimated(flat), layout, customers, tables)

    def at(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """With the totals of the contexts that a task numbers from 0."""
        return replace(self, flat=np.concatenate([customers, tables, self.flat[-Totals.size(self.layout, 0) + len(self.layout.frequent) :]]))

    @property
    def held(self) -> int:
        """Contexts whose totals are here."""
        return (len(self.flat) - 2 * PARENTS - 9) // 2

    def at_root(self, words: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Root customers and tables of words, frequent ones' from here."""
        slot, dealt = _find(self.layout.frequent, words, True)
        if not len(self.layout.frequent):
            return customers, tables
        return np.where(dealt, self.root_customers[slot], customers), np.where(dealt, self.root_tables[slot], tables)

    @property
    def contexts(self):
        n = self.held
        return self.flat[:n], self.flat[n : 2 * n]

    @property
    def parents(self):
        at = 2 * self.held
        return self.flat[at : at + PARENTS], self.flat[at + PARENTS : at + 2 * PARENTS]

    @property
    def root(self):
        at = 2 * self.held + 2 * PARENTS
        return self.flat[at], self.flat[at + 1]

    @property
    def words(self) -> float:
        return self.flat[-1]

    @staticmethod
    def estimated(flat: np.ndarray) -> tuple[float, float, float]:
        """Discounts from the dishes with one and two customers."""
        pairs = flat[-7:-1].reshape(3, 2)
        return tuple(float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in pairs)

    def root_probability(self, customers, tables):
        c, t = self.root
        d = self.discounts[2]
        # every known word, and one for all unknown ones, is equally likely below the root
        return (customers - d * tables + (STRENGTH + d * t) / (self.words + 1)) / (STRENGTH + c)

    def parent_probability(self, parent, customers, tables, root):
        c, t = self.parents
        d = self.discounts[1]
        return (customers - d * tables + (STRENGTH + d * t[parent]) * root) / (STRENGTH + c[parent])

    def context_probability(self, context, customers, tables, below):
        c, t = self.contexts
        d = self.discounts[0]
        return (customers - d * tables + (STRENGTH + d * t[context]) * below) / (STRENGTH + c[context])


_STIRLING: dict[float, np.ndarray] = {}


def _log_stirling(d: float) -> np.ndarray:
    """Logs of generalised Stirling numbers: weights of seating c customers at t tables."""
    if d not in _STIRLING:
        s = np.full((EXACT_CUSTOMERS + 1, EXACT_CUSTOMERS + 2), -np.inf)
        s[1, 1] = 0
        for c in range(1, EXACT_CUSTOMERS):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                s[c + 1, t] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - d * t, 0)) + s[c, t])
        _STIRLING[d] = s
    return _STIRLING[d]


def draw_tables(customers, tables, total_tables, base, d: float, u1, u2) -> np.ndarray:
    """A blocked Gibbs draw of each dish's number of tables, given the restaurant's other tables.

    Up to EXACT_CUSTOMERS customers the number comes from its exact conditional.
    More are seated one stretch after the other, each a quarter longer than what
    sits already, with the number of new tables drawn around its mean.
    """
    out = np.ones(len(customers), np.int64)
    others = np.maximum(total_tables - tables, 0)
    stirling = _log_stirling(d)
    for c in np.unique(customers[(customers > 1) & (customers <= EXACT_CUSTOMERS)]):
        at = np.flatnonzero(customers == c)
        t = np.arange(c)
        for s in range(0, len(at), 100_000):
            i = at[s : s + 100_000]
            log_w = np.cumsum(np.log((STRENGTH + d * (others[i, None] + t)) * base[i, None]), axis=1) + stirling[c, 1 : c + 1]
            w = np.cumsum(np.exp(log_w - log_w.max(axis=1, keepdims=True)), axis=1)
            out[i] = np.minimum((w < (u1[i] * w[:, -1])[:, None]).sum(axis=1) + 1, c)
    i = np.flatnonzero(customers > EXACT_CUSTOMERS)
    seated = np.ones(len(i))
    step = 0
    while len(i):
        more = np.minimum(np.maximum(1, np.floor(seated / 4)), customers[i] - seated)
        mass = (STRENGTH + d * (others[i] + out[i])) * base[i]
        p = mass / (seated + more / 2 - d * out[i] + mass)
        mean = more * p
        a, b = uniform((u1[i] * 2**53).astype(np.uint64), step), uniform((u2[i] * 2**53).astype(np.uint64), step)
        z = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        spread = np.where(mean >= 1, np.sqrt(mean * (1 - p)) * z, 0)
        new = np.minimum(np.floor(np.maximum(mean + spread, 0) + uniform((u2[i] * 2**53).astype(np.uint64), step, 5)), more)
        out[i] += new.astype(np.int64)
        seated = seated + more
        going = seated < customers[i]
        i, seated, step = i[going], seated[going], step + 1
    return np.minimum(out, customers)


def draw_root_tables(words: np.ndarray, customers: np.ndarray, tables: np.ndarray, totals: Totals, number: int) -> np.ndarray:
    base = np.full(len(customers), 1 / (totals.words + 1))
    return draw_tables(customers, tables, np.full(len(customers), totals.root[1]), base, totals.discounts[2], uniform(words, number, 4), uniform(words, number, 5))


def context_tables(state: DataFrame, layout: Layout, what: str) -> DataFrame:
    """What each bucket seats in its contexts, one row a bucket and shard: (shard, bucket, contexts, tables, asked).

    ``dishes`` gives all contexts' dishes and which totals the bucket needs, ``added`` the tables beyond one a
    dish of the contexts that it needs, ``samples`` all contexts' tables in each sample.
    """
    schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("contexts", "tables", "asked")]])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Seating(row, layout)
                n = len(s.places)
                if what == "added":
                    which, values = s.asked, [np.bincount(s.context, s.tables - 1, n)]
                elif what == "dishes":
                    which, values = np.arange(n), [np.bincount(s.context, minlength=n)]
                else:
                    which, values = np.arange(n), []
                    for k in range(len(row["samples"])):
                        s.set_sample(k)
                        values.append(np.bincount(s.context, s.tables, n))
                asked = np.isin(np.arange(n), s.asked) if what == "dishes" else None
                shard = layout.shard(layout.home(s.places[which]))
                which = which[np.argsort(shard, kind="stable")]
                edges = np.searchsorted(np.sort(shard), np.arange(layout.shards + 1))
                out = []
                for k in range(layout.shards):
                    e = which[edges[k] : edges[k + 1]]
                    if len(e):
                        out.append({"shard": k, "bucket": row["bucket"], "contexts": _pack(s.places[e]), "tables": _pack_ints(np.concatenate([v[e] for v in values])), "asked": None if asked is None else _pack(asked[e].astype(np.uint8))})
                yield pa.RecordBatch.from_pylist(out, schema)

    return state.mapInArrow(run, "shard int, bucket int, contexts binary, tables binary, asked binary")


def _summed(rows: pa.Table, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a shard, their tables in each sample over all buckets, and place of each row's contexts in turn."""
    contexts = [_unpack(x.as_py(), np.int64) for x in rows["contexts"]]
    tables = [_ints(x.as_py()).reshape(samples, -1) for x in rows["tables"]]
    places, at = np.unique(_joined(contexts), return_inverse=True)
    each = np.concatenate([np.zeros((samples, 0), np.int64), *tables], axis=1)
    return places, np.array([np.bincount(at, x, len(places)) for x in each]).reshape(samples, len(places)), at


def sum_tables(added: DataFrame, tasks: int) -> DataFrame:
    """Sums over buckets of what ``context_tables`` gives, for each bucket those that it asks for: (bucket, shard, totals)."""

    def run(rows: pa.Table) -> pa.Table:
        _, total, at = _summed(rows, 1)
        out, begin = {"bucket": [], "shard": [], "totals": []}, 0
        for r in range(len(rows)):
            asked = rows["asked"][r].as_py()
            end = begin + len(_unpack(rows["contexts"][r].as_py(), np.int64))
            mine = total[0][at[begin:end]]
            out["bucket"].append(rows["bucket"][r].as_py())
            out["shard"].append(rows["shard"][r].as_py())
            out["totals"].append(_pack_ints(mine if asked is None else mine[_unpack(asked, np.uint8) > 0]))
            begin = end
        return pa.table(out, pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("totals", pa.binary())]))

    return added.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, "bucket int, shard int, totals binary")


def sweep(state: DataFrame, totals: Totals, number: int, keep: bool, tasks: int) -> DataFrame:
    """Reseat every dish at every level, given all restaurants' totals after the sweep before.

    Draws depend on the word, the restaurant and the sweep alone, not on partitions.
    """
    first = number == 0

    def run(held: pa.Table, said: pa.Table) -> pa.Table:
        row = held.slice(0, 1).to_pylist()[0]
        s = Seating(row, totals.layout)
        order = np.argsort(said["shard"].to_numpy())
        dishes = _joined([_ints(said["totals"][int(i)].as_py()) for i in order])
        added = 0
        if not first:
            dishes, added = _ints(row["dishes"]), dishes
        row["dishes"] = _pack_ints(dishes)
        seated = np.zeros(len(s.places), np.int64)
        seated[s.asked] = dishes + added
        root = totals.root_probability(*totals.at_root(s.words, s.root_customers, s.root_tables))
        parent = totals.parent_probability(s.parents, s.parent_customers, s.parent_tables, root[s.group_owner])
        i = s.drawn
        word, context = s.words[s.owner[i]], s.contexts[i]
        s.tables[i] = draw_tables(s.customers[i], s.tables[i], seated[s.context[i]], parent[s.group[i]], totals.discounts[0], uniform(word, context, number, 0), uniform(word, context, number, 1))
        c = s.parent_customers
        i = np.flatnonzero(c > 1)
        word, at = s.words[s.group_owner[i]], s.parents[i]
        after = np.ones(len(c), np.int64)
        after[i] = draw_tables(c[i], np.minimum(s.parent_tables, c)[i], totals.parents[1][at], root[s.group_owner[i]], totals.discounts[1], uniform(word, at, number, 2), uniform(word, at, number, 3))
        s.parent_tables = after
        c = s.root_customers
        s.root_tables = draw_root_tables(s.words, c, np.minimum(s.root_tables, c), totals, number)
        row["tables"], row["parent_tables"], row["root_tables"] = (_pack_ints(x) for x in (s.tables, s.parent_tables, s.root_tables))
        if keep:
            row["samples"] = [*row["samples"], _pack_ints(np.concatenate([s.tables, s.parent_tables, s.root_tables]))]
        return pa.Table.from_pylist([row], _STATE_SCHEMA)

    said = sum_tables(context_tables(state, totals.layout, "dishes" if first else "added"), tasks)
    return state.repartition(tasks, "bucket").groupBy("bucket").cogroup(said.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(run, STATE)


def gather_totals(state: DataFrame, layout: Layout) -> np.ndarray:
    """Sums over buckets: two numbers for each parent and one for each frequent word, whatever the corpus."""
    size = Totals.size(layout, 0)

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                total += Seating(row, layout).partial_totals()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "v": total[at]})

    flat = np.zeros(size)
    partial = state.withColumn("samples", F.array().cast("array<binary>")).mapInArrow(run, "i int, v double")
    sums = partial.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return flat


def answer(asks: DataFrame, state: DataFrame, layout: Layout, samples: int, tasks: int) -> DataFrame:
    """What a bucket holds of the entries asked for: (block, bucket, entries, groups, roots).

    These are an entry's customers and its tables in each sample, and customers and tables in each sample of each
    of its (word, parent), and of its words at the root.
    """

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"block": [], "bucket": [], "entries": [], "groups": [], "roots": []}
        s = Seating(held.slice(0, 1).to_pylist()[0], layout)
        key = (s.owner << 32) | s.context
        group_key = (s.group_owner << PARENT_BITS) | s.parents
        entries, groups, roots = [s.customers], [], []
        for k in range(samples):
            s.set_sample(k)
            entries.append(s.tables)
            groups += [s.parent_customers, s.parent_tables]
            roots += [s.root_customers, s.root_tables]
        look = lambda columns, i, ok: _pack_ints(np.concatenate([np.where(ok, x[i], 0) if len(x) else np.zeros(len(i)) for x in columns]))
        for r in range(len(asked)):
            words, sizes = _unpack(asked["words"][r].as_py(), np.int64), _ints(asked["sizes"][r].as_py())
            context = _unpack(asked["contexts"][r].as_py(), np.int64)
            at, known = _find(s.words, words, True)
            own = known & ~_find(layout.frequent, words, True)[1]  # frequent words' are held by Totals
            w, parent = np.repeat(at, sizes), layout.parent(context)
            ok = np.repeat(known, sizes)
            new = _changes(np.repeat(np.arange(len(words)), sizes), parent)
            place, seen = _find(s.places, context, ok)
            out["block"].append(asked["block"][r].as_py())
            out["bucket"].append(asked["bucket"][r].as_py())
            out["entries"].append(look(entries, *_find(key, (w << 32) | place, seen)))
            out["groups"].append(look(groups, *_find(group_key, ((w << PARENT_BITS) | parent)[new], ok[new])))
            out["roots"].append(look(roots, at, own))
        return pa.table(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("entries", "groups", "roots")]]))

    asked = asks.select("block", "bucket", "words", "sizes", "contexts").repartition(tasks, "bucket").groupBy("bucket")
    return asked.cogroup(state.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(run, "block long, bucket int, entries binary, groups binary, roots binary")


def answer_contexts(names: DataFrame, state: DataFrame, layout: Layout, samples: int, tasks: int) -> DataFrame:
    """Tables in each sample of each context of each block: (block, bucket, tables)."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        places, total, _ = _summed(held, samples)
        out = {"block": [], "bucket": [], "tables": []}
        for r in range(len(asked)):
            at, known = _find(places, _unpack(asked["numbers"][r].as_py(), np.int64), True)
            out["block"].append(asked["block"][r].as_py())
            out["bucket"].append(asked["bucket"][r].as_py())
            out["tables"].append(_pack_ints(np.concatenate([np.where(known, x[at], 0) if len(x) else np.zeros(len(at)) for x in total])))
        return pa.table(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("tables", pa.binary())]))

    named = names.where("block >= 0").select(F.floor(F.col("bucket").cast("long") * layout.shards / F.lit(layout.buckets)).cast("int").alias("shard"), "block", "bucket", "numbers")
    seated = context_tables(state, layout, "samples").select("shard", "contexts", "tables")
    return named.repartition(tasks, "shard").groupBy("shard").cogroup(seated.repartition(tasks, "shard").groupBy("shard")).applyInArrow(run, "block long, bucket int, tables binary")


def _find(keys: np.ndarray, wanted: np.ndarray, ok) -> tuple[np.ndarray, np.ndarray]:
    """Place of wanted keys among sorted ones, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, ok & (keys[at] == wanted)


def _rows_of(rows: pa.Table, column: str, n: int) -> np.ndarray:
    """A packed column's n arrays over all buckets in order."""
    parts = rows.filter(pc.is_valid(rows[column]))
    order = np.argsort(parts["bucket"].to_numpy())
    return np.concatenate([_ints(parts[column][int(i)].as_py()).reshape(n, -1) for i in order], axis=1)


def score_texts(docs: DataFrame, train: Column, burn_in: int = 2, samples: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    The model learns from all rows for which ``train`` holds. It is a hierarchy
    of Pitman-Yor restaurants: a root, parents chosen by the last two bytes of the
    word before, and below them one context restaurant for each whole word before; a restaurant's
    customers are its children's tables. Tables are sampled by Gibbs sweeps over
    all dishes, with restaurants' totals exchanged after each sweep and discounts
    estimated from the counts. ``score`` is the log10 probability of the text's
    words and its end, averaged over ``samples`` sweeps after ``burn_in``;
    perplexity is ``10 ** (-score / n_tokens)``. ``base_score`` is the smoothed
    unigram model's.

    Work is exchanged as packed blocks: documents become streams of words, which
    buckets of words number; blocks then give counts of (word, context) entries,
    buckets gather the counts, hold the seating and
    answer what blocks ask. A frequent word's entries are dealt to buckets by their
    parent restaurants, so that no bucket holds what all blocks ask of one word.
    Totals of contexts are exchanged as a table, by shards of contexts; the driver sees
    two numbers for each parent (65,536 at most) and one for each frequent word.

    Null and empty texts are the end token alone. A null ``train`` counts as
    false. Null ids and repeated rows are scored row by row; without training
    rows all probabilities are those of one unknown word. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, tasks = min(MOST_BUCKETS, max(8, math.ceil(size / BUCKET_BYTES))), max(8, math.ceil(size / TASK_BYTES))
    layout = Layout(Layout.bits_for(size), np.zeros(0, np.int64), buckets, min(buckets, max(8, math.ceil(size / SHARD_BYTES))))
    blocks = scratch.table(make_blocks(read, buckets).withColumn("part", F.when(F.col("bucket") < 0, "body").otherwise("words")), "blocks", "part")
    names = scratch.table(number_words(blocks, layout, tasks), "names")
    scratch.drop_part(blocks, "part=words")
    frequent, train_tokens = frequent_words(names)
    layout = replace(layout, frequent=frequent)
    asks = scratch.table(ask(blocks, names, layout, tasks), "asks")
    state = scratch.table(merge_counts(asks, layout, tasks), "counts")
    totals = Totals.of(gather_totals(state, layout), layout, None, -1)
    kept: list[Totals] = []
    for number in range(burn_in + samples):
        after = scratch.table(sweep(state, totals, number, number >= burn_in, tasks), "seating")
        scratch.drop(state)
        state = after
        totals = Totals.of(gather_totals(state, layout), layout, totals, number)
        if number >= burn_in:
            kept.append(totals)
    said = answer(asks, state, layout, samples, tasks).unionByName(answer_contexts(names, state, layout, samples, tasks), allowMissingColumns=True)
    floor = train_tokens + 0.1 * (totals.words + 1)
    kind = read.schema["doc_id"].dataType.simpleString()

    def total(rows: pa.Table, said: pa.Table) -> pa.Table:
        b = Block(rows, layout)
        entries, groups, roots = _rows_of(said, "entries", 1 + samples), _rows_of(said, "groups", 2 * samples), _rows_of(said, "roots", 2 * samples)
        tables = _rows_of(said, "tables", samples)
        words, parent = b.numbers[b.word], layout.parent(b.numbers[b.context])
        group, own = np.cumsum(_changes(words, parent)) - 1, np.cumsum(_changes(words, b.place)) - 1
        p = np.zeros(len(words))
        for k, totals in enumerate(kept):
            root = totals.root_probability(*totals.at_root(words, roots[2 * k][own], roots[2 * k + 1][own]))
            below = totals.parent_probability(parent, groups[2 * k][group], groups[2 * k + 1][group], root)
            p += totals.at(b.counts, tables[k]).context_probability(b.context, entries[0], entries[1 + k], below)
        n = len(b.lengths)
        of_doc = np.repeat(np.arange(n), b.lengths)
        by_doc = lambda x: np.bincount(of_doc, x, n)
        base = np.log10((b.counts + 0.1) / floor)
        return pa.table({
            "doc_id": rows.filter(pc.equal(rows["bucket"], -1))["ids"].combine_chunks().flatten(), "n_tokens": b.lengths, "n_known": by_doc(b.counts[b.stream] > 0).astype(np.int64),
            "train_tokens": np.full(n, train_tokens, np.int64), "base_score": by_doc(base[b.stream]), "score": by_doc(np.log10(p / samples)[b.entry]),
        })

    bodies = blocks.where("part = 'body'").select("block", "bucket", "ids", "train", "lengths", "stream", "uses", "start")
    both = bodies.unionByName(names.where("block >= 0").select("block", "bucket", "numbers", "counts"), allowMissingColumns=True)
    return both.repartition(tasks, "block").groupBy("block").cogroup(said.repartition(tasks, "block").groupBy("block")).applyInArrow(total, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
