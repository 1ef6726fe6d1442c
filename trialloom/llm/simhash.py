"""SimHash near-duplicates with vantage-point trees over fingerprint words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import LOWER, Scratch, local_components, text_buffers, text_parts, word_spans
from trialloom.llm.components import connected_components

SHINGLE_SEED = 42
LEAF_ROWS = 4096
SAMPLE_ROWS = 16384
TILE = 4096


def words_of(bits: int) -> list[tuple[int, int]]:
    """First bit and number of bits of the words that a fingerprint is cut into.

    Of two fingerprints ``bits`` apart at least one word is at most 1 apart, with as few words as that takes."""
    n = max(1, -(-(bits + 1) // 2))
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def joined_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of a batch joined by one space each, the first byte of each word, the first word of each row."""
    raw, offsets = text_buffers(column)
    raw = LOWER[raw]
    starts, ends, row = word_spans(raw, offsets)
    place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    joined = np.full(place[-1], 0x20, np.uint8)
    inside = np.arange(place[-1]) - np.repeat(place[:-1], ends - starts + 1)
    body = inside < np.repeat(ends - starts, ends - starts + 1)
    joined[body] = raw[(np.repeat(starts, ends - starts + 1) + inside)[body]]
    return joined, place, np.searchsorted(row, np.arange(len(offsets)))


def fingerprints_of(column: pa.Array, width: int) -> np.ndarray:
    """64-bit SimHash of each text of a column.

    Words are lower-cased (A-Z) runs without ASCII white space, shingles are
    ``width`` words joined by one space, each as often as it occurs; fewer words
    make one shingle, none make fingerprint zero. A bit is set if it is set in
    more than half of the shingles' XXH64 values.
    """
    joined, place, first = joined_words(column)
    text = joined.tobytes()
    out = np.zeros(len(first) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    last = (place[1:] - 1).tolist()
    begin = place.tolist()
    for r in range(len(out)):
        a, b = int(first[r]), int(first[r + 1])
        if a == b:
            continue
        w = min(width, b - a)
        counts, n = np.zeros(64, np.int64), b - a - w + 1
        for s in range(a, a + n, 65536):
            e = min(s + 65536, a + n)
            h = np.fromiter((digest(text[x:y], SHINGLE_SEED) for x, y in zip(begin[s:e], last[s + w - 1 : e + w - 1])), np.uint64, e - s)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
        out[r] = weights[counts * 2 > n].sum(dtype=np.uint64)
    return out


class VantageTree:
    """A vantage-point tree over one word of the fingerprint.

    A node holds a vantage point and a radius; values within the radius go to
    its inner child, the others to the outer one. Leaves are shards. Built from
    a bounded sample, it routes any value.
    """

    def __init__(self, sample: np.ndarray, leaves: int, seed: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # point, radius, inner, outer; a child below 0 is leaf -1 - child
        self.leaves = 0
        self.root = self._build(sample, leaves, np.random.default_rng(seed))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _build(self, sample: np.ndarray, leaves: int, rng) -> int:
        if leaves < 2 or len(sample) < 4:
            return self._leaf()
        # the point whose distances spread most leaves fewest values near its boundary
        points = rng.choice(sample, min(8, len(sample)), replace=False)
        distances = [np.bitwise_count(sample ^ p).astype(int) for p in points]
        best = int(np.argmax([d.std() for d in distances]))
        d = distances[best]
        radius = int(np.median(d))
        if (d <= radius).all():
            radius -= 1
        inner = d <= radius
        if not inner.any() or inner.all():
            return self._leaf()
        at = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        share = max(1, round(leaves * inner.mean()))
        left = self._build(sample[inner], share, rng)
        right = self._build(sample[~inner], max(1, leaves - share), rng)
        self.nodes[at] = (int(points[best]), radius, left, right)
        return at

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (position, leaf, home): every value has one home leaf; it also visits leaves that
        may hold values within ``reach`` that do not visit its own home."""
        done: list[tuple[np.ndarray, int, np.ndarray]] = []
        work = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while work:
            node, rows, home = work.pop()
            if not len(rows):
                continue
            if node < 0:
                done.append((rows, -1 - node, home))
                continue
            point, radius, inner, outer = self.nodes[node]
            d = np.bitwise_count(values[rows] ^ np.uint64(point)).astype(int)
            # triangle bounds: an inner value is at least d - radius away, an outer one at least radius + 1 - d.
            # Of two homes on either side, the inner one visits the outer side.
            into = np.where(home, d <= radius, d - radius <= reach)
            over = radius + 1 - d <= reach
            work.append((inner, rows[into], home[into]))
            work.append((outer, rows[over | (home & (d > radius))], (home & (d > radius))[over | (home & (d > radius))]))
        if not done:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return np.concatenate([r for r, _, _ in done]), np.concatenate([np.full(len(r), x) for r, x, _ in done]), np.concatenate([h for _, _, h in done])


def simhash_fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, fp): the fingerprint of each text as a signed long; null text as empty."""

    def run(batches):
        for part in text_parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fingerprints_of(part.column("text"), width).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, fp long")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_hash, text); the hash tells rows of one id but different texts apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.lit(9), F.coalesce(F.col(text_col), F.lit("")))


def link_fingerprints(groups: DataFrame, bits: int, scratch: Scratch, seed: int = 11) -> DataFrame:
    """Links (rep, root) that span the pairs of ``groups`` (fp, rep) at most ``bits`` apart.

    Two such fingerprints are at most 1 apart in one of their words at least
    (``words_of``). For each word a vantage-point tree deals the fingerprints to shards by
    Hamming distance; those near a boundary, by the triangle bounds, also visit
    the shards beyond it. Every pair within a shard is verified on all 64 bits.
    Shards with many rows are cut into tiles, so no group grows with the input.
    """
    spark = groups.sparkSession
    n = groups.count()
    words = words_of(bits)
    reach = bits // len(words)
    leaves = max(1, math.ceil(n / LEAF_ROWS))
    trees = []
    if leaves > 1:
        of = max(2, math.ceil(n / SAMPLE_ROWS))
        sample = groups.where(F.pmod(F.xxhash64(F.lit(seed), "fp"), F.lit(of)) == 0).select("fp").toPandas()["fp"].to_numpy().view(np.uint64)
    else:
        sample = np.zeros(0, np.uint64)
    for first, size in words:
        word = np.sort(sample) >> np.uint64(first) & np.uint64((1 << size) - 1)
        trees.append(VantageTree(word, leaves, seed + first))

    def route(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (first, size) in enumerate(words):
                rows, leaf, home = trees[t].route(fp >> np.uint64(first) & np.uint64((1 << size) - 1), reach)
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(home), picked.column("fp"), picked.column("rep")], names=["tree", "leaf", "home", "fp", "rep"])

    routed = scratch.table(groups.select("fp", "rep").mapInArrow(route, "tree int, leaf int, home boolean, fp long, rep long"), "routed")
    # as many rows as the trees have leaves
    homes = routed.where("home").groupBy("tree", "leaf").count().where(F.col("count") > TILE)
    tiles = F.broadcast(homes.select("tree", "leaf", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    dealt = routed.join(tiles, ["tree", "leaf"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("fp"), "tiles").cast("int")).otherwise(F.lit(0))
    dealt = dealt.withColumn("own", own).withColumn("tile", F.explode(F.sequence("own", F.col("tiles") - 1)))
    dealt = dealt.withColumn("home", F.col("home") & (F.col("own") == F.col("tile")))

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("home", "descending"), ("rep", "ascending")])
        fp = group["fp"].to_numpy().view(np.uint64)
        homes, n = int(np.count_nonzero(group["home"].to_numpy())), len(fp)
        label = np.arange(n)
        for s in range(0, homes, 256):
            for c in range(s, n, 16384):
                d = np.bitwise_count(fp[s : min(s + 256, homes), None] ^ fp[None, c : c + 16384])
                i, j = np.nonzero(d <= bits)
                i, j = i + s, j + c
                ok = i < j
                if ok.any():
                    label = local_components(n, i[ok], j[ok], label)
        use = label != np.arange(n)
        rep = group["rep"].to_numpy()
        return pa.table({"rep": rep[use], "root": rep[label[use]]})

    return dealt.select("tree", "leaf", "tile", "home", "fp", "rep").groupBy("tree", "leaf", "tile").applyInArrow(verify, "rep long, root long")


def simhash_components(docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    Texts whose fingerprints differ in at most ``bits`` bits link; component_id
    is the smallest doc_id reachable by links, the row's own included. All pairs
    within ``bits`` are found (see ``link_fingerprints``); equal fingerprints
    are one node. A null text counts as empty (fingerprint zero, linked like any
    other). Rows with a null id keep fingerprint and take the component of their
    fingerprint; null if no row with an id has it or links to it. Repeated rows
    are each returned. Other columns are ignored; an empty table gives no rows.
    """
    return _placed(docs, width, bits, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(docs: DataFrame, width: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(simhash_fingerprints(docs, width, id_col, text_col), "prints")
    groups = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).where("least is not null"), "groups")
    links = scratch.table(link_fingerprints(groups.select("fp", F.col("fp").alias("rep")), bits, scratch).distinct(), "found")
    parts = connected_components(links, "rep", "root", scratch).withColumnRenamed("node", "fp")
    rooted = scratch.table(groups.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), "rooted")
    known = scratch.table(rooted.join(rooted.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id"), "known")
    return prints.join(known, "fp", "left")


#: Ids of rows that go are broadcast up to so many (32 MB); beyond, documents and ids are joined by exchange.
BROADCAST_IDS = 2_000_000


def drop_near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents (see ``simhash_components``), with all its columns.

    The row with the group's smallest id stays (``first_of_groups``). While the
    ids to drop are few, texts are not exchanged.
    """
    return first_of_groups(docs, _placed(docs, width, bits, id_col, text_col), id_col, text_col, Scratch(docs.sparkSession, "distinct"))


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """One row of ``docs`` for each group; ``groups`` are rows (doc_id, text_hash, group, component_id), one for each row of
    ``docs``, component_id being the group's smallest id.

    The row with the smallest id stays; of rows of that id in one group the one
    with the smallest hash of the text, of equal rows the first by all columns
    written as JSON. Rows of one id but different groups are judged apart. Rows
    with a null id cannot be named as anyone's copy and stay.
    """
    named = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.min("group").alias("group"), F.min("component_id").alias("c"))
    # of a group's rows only those of its smallest id can stay
    best = named.where("doc_id = c").groupBy("group").agg(F.min("text_hash").alias("best"))
    marked = named.join(best, "group", "left").withColumn("first", (F.col("doc_id") == F.col("c")) & (F.col("text_hash") == F.col("best"))).where("not first or n > 1")
    marked = scratch.table(marked.select("doc_id", "text_hash", "first"), "marked")
    few = marked.count() <= BROADCAST_IDS
    keys = ["doc_id", "text_hash"]
    side = lambda df: F.broadcast(df.select(keys)) if few else df.select(keys)
    # the rows' own columns are held apart, so that no name clashes with the keys
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"))
    kept = rows.join(side(marked), keys, "left_anti").select("row")
    again = marked.where("first")
    if not again.isEmpty():
        repeated = rows.join(side(again), keys, "left_semi").groupBy(keys).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.union(repeated.select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
