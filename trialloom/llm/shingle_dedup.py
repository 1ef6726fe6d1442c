"""Near-duplicates by the Jaccard similarity of word shingles, without loss."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch, mix64, span_hashes, text_parts
from trialloom.llm.components import connected_components
from trialloom.llm.simhash import BROADCAST_IDS, fingerprints_of, first_of_groups, joined_words, link_fingerprints, texts_of

#: The order of shingles is fitted to so many documents and knows so many frequent shingles.
SAMPLE_DOCS = 20_000
FREQUENT = 200_000
#: Similarities are compared with this margin for binary fractions.
MARGIN = 1e-9
#: A pair is left to an earlier shared shingle if that is among so many before this one in both sets.
LOOK_BACK = 32
#: Fingerprints at most so far apart make first candidates.
BITS = 4
#: Counts of a set's shingles by hash, which bound what two sets share.
CELLS = 512


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as sorted 64-bit hashes, and where each row's begin.

    Words and shingles are those of ``simhash.fingerprints_of``: fewer words than
    ``width`` make one shingle, none make an empty set.
    """
    joined, place, first = joined_words(column)
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    row = np.repeat(np.arange(len(words)), count)
    begin = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    h = span_hashes(joined, place[begin], place[begin + np.minimum(words, width)[row]] - 1)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(words) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)])
        return mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each set's counts in CELLS cells, up to 255."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    cells = np.bincount(row * CELLS + (h % np.uint64(CELLS)).astype(np.int64), minlength=n * CELLS)
    return [x.tobytes() for x in np.minimum(cells, 255).astype(np.uint8).reshape(n, CELLS)]


def prefix_length(size, similarity: float):
    """Two sets so similar share one of so many first elements, in any order common to all sets."""
    return size - np.ceil(similarity * size - MARGIN).astype(np.int64) + 1


def _parts(batches, width: int):
    for part in text_parts(batches, "text"):
        yield part, *shingle_sets(part.column("text"), width)


def _new_sets(batches, width: int):
    """Signatures, elements and bounds of the sets that a task sees for the first time (of its last million or so)."""
    seen: set[int] = set()
    for _, h, bounds in _parts(batches, width):
        sig = signatures(h, bounds)
        fresh = np.array([s not in seen and not seen.add(s) for s in sig.tolist()], bool)
        size = np.diff(bounds)
        yield sig[fresh], h[np.repeat(fresh, size)], np.concatenate([[0], np.cumsum(size[fresh])])
        if len(seen) > 1_000_000:
            seen.clear()


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that a bounded sample of documents holds more than once, and in how many.

    They only set the order of shingles; any order finds all pairs.
    """
    of = max(1, math.ceil(docs.count() / SAMPLE_DOCS))

    def run(batches):
        for _, h, _ in _parts(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(of)) == 0)
    n = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    rows = n.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    h, n = rows["shingle"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (shingle, sig, size, pos, own): the first shingles of each document's set, rare ones first, and the share
    of its shingles that the sample holds once at most."""
    known, seen = frequent_shingles(docs, width)

    def run(batches):
        for sig, h, bounds in _new_sets(batches, width):
            size = np.diff(bounds)
            row = np.repeat(np.arange(len(size)), size)
            n = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                n = np.where(known[at] == h, seen[at], 0)
            order = np.lexsort((h, n, row))
            pos = np.arange(len(h)) - bounds[:-1][row]
            use = pos < prefix_length(size, similarity)[row]
            own = (np.bincount(row, n == 0, len(size)) / np.maximum(size, 1)).astype(np.float32)
            row = row[use]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][use].view(np.int64)), pa.array(sig[row]), pa.array(size[row].astype(np.int32)), pa.array(pos[use].astype(np.int32)), pa.array(own[row])], names=["shingle", "sig", "size", "pos", "own"])

    return docs.mapInArrow(run, "shingle long, sig long, size int, pos int, own float")


def _can_reach(similarity: float):
    """Whether sizes, and what follows the first shared shingle in both sets, leave room for the similarity.

    Nothing before the first shared shingle is shared, so both sets must have enough left from there. Other shared
    shingles may fail this: the first one brings the pair."""
    a, b = F.col("a_size"), F.col("b_size")
    need = F.ceil(similarity / (1 + similarity) * (a + b) - F.lit(MARGIN))
    return (F.least(a, b) >= similarity * F.greatest(a, b) - MARGIN) & (a - F.col("a_pos") >= need) & (b - F.col("b_pos") >= need)


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in ("sig", "size", "pos", *more)])


def _pairs(df: DataFrame, similarity: float) -> DataFrame:
    return df.where(_can_reach(similarity)).select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct()


def promising(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b, bound): those of the pairs whose sketches leave room for the similarity, and how much they leave."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("x", "y"))
            m, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("x_size", "y_size"))
            both = np.minimum(np.minimum(x, y).sum(axis=1, dtype=np.int64), np.minimum(m, n))
            full = ((x == 255) & (y == 255)).any(axis=1)  # such counts bound nothing
            both = np.where(full, np.minimum(m, n), both)
            bound = both / np.maximum(m + n - both, 1)
            ok = bound >= similarity - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(bound[ok])], names=["a", "b", "bound"])

    side = lambda c, v: known.select(F.col("sig").alias(c), F.col("sketch").alias(v), F.col("size").alias(f"{v}_size"))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "x_size", "y_size").mapInArrow(run, "a long, b long, bound double")


def fingerprint_pairs(known: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """Rows (a, b) of signatures: pairs that span the sets of ``known`` (sig, fp) whose SimHash fingerprints are at most ``bits``
    apart, from the vantage-point trees of ``link_fingerprints``; equal fingerprints pair with their least signature."""
    groups = scratch.table(known.groupBy("fp").agg(F.min("sig").alias("rep")), "fingerprints")
    equal = known.join(groups, "fp").where("sig <> rep").select("sig", "rep")
    found = equal.union(link_fingerprints(groups, bits, scratch).select("rep", "root").toDF("sig", "rep"))
    return found.select(F.least("sig", "rep").alias("a"), F.greatest("sig", "rep").alias("b")).distinct()


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) of signatures whose sets are similar enough."""
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(reps, "sig").select(F.col("rep").alias("doc_id")).distinct(), "asked")
    few = ids.count() <= BROADCAST_IDS

    def run(batches):
        for sig, h, bounds in _new_sets(batches, width):
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sig), sets], names=["sig", "shingles"])

    sets = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "sig long, shingles array<long>")

    both = pairs.select("a", "b").join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("all"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(F.col("shared") >= similarity * (F.col("all") - F.col("shared")) - MARGIN).select("a", "b").distinct()


def shingle_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, group, component_id) for each row of ``docs`` with an id.

    Texts whose sets of shingles have a Jaccard similarity of ``similarity`` or
    more link; component_id is the smallest doc_id reachable by links, group the
    same for all texts that links join. Rows of one id but different texts are different documents. No link
    is lost and none is made by less similar texts, but for collisions of 64-bit
    hashes. Equal sets are one node; texts without words have equal, empty sets.

    First candidates are texts whose SimHash fingerprints lie near each other
    (``fingerprint_pairs``). Fingerprints of similar sets may lie farther apart, so an exact way follows for the rest:
    similar sets share one of their first shingles in any common order
    (``prefix_length``), and rare shingles come first. Of the documents that
    share such a shingle each is first paired with one, another for each
    shingle, and compared with the most promising of them; then all are compared
    that no links join yet, at the first shingle that they share. Pairs whose sketches rule the similarity out need no
    comparison; all others are verified on whole sets.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    docs = texts_of(docs, id_col, text_col).where("doc_id is not null")

    def sign(batches):
        for part, h, bounds in _parts(batches, width):
            prints = fingerprints_of(part.column("text"), width).view(np.int64)
            own = [pa.array(signatures(h, bounds)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(sketches(h, bounds), pa.binary()), pa.array(prints)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *own], names=["doc_id", "text_hash", "sig", "size", "sketch", "fp"])

    signed = scratch.table(docs.mapInArrow(sign, "doc_id long, text_hash long, sig long, size int, sketch binary, fp long"), "signed")
    # equal sets have equal sizes and sketches; of their fingerprints, which count repeats, one will do
    known = scratch.table(signed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("fp").alias("fp")), "known")
    reps = known.select("sig", "rep")
    named = signed.select("doc_id", "sig").join(reps, "sig")
    # ids that only repeat the set of a smaller one
    copies = scratch.table(named.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x = y and x <> doc_id").select("doc_id"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    single = docs.join(copies, "doc_id", "left_anti").select("doc_id", "text")

    rows = scratch.table(prefixes(single, width, similarity), "prefixes")
    several = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    shared = scratch.table(rows.join(several, "shingle").distinct(), "shared")
    scratch.drop(rows)

    # the document with the fewest shingles of its own is nearest to what a group of copies was made from
    hubs = _side(shared, "b", "own").groupBy("shingle").agg(F.min_by(F.struct("b_sig", "b_size", "b_pos"), F.struct("b_own", F.xxhash64("b_sig"))).alias("hub")).select("shingle", "hub.*")
    starred = _pairs(_side(shared, "a").join(hubs, "shingle").where("a_sig <> b_sig"), similarity)
    starred = scratch.table(promising(starred, known, similarity), "starred")
    best = starred.select(F.explode(F.array("a", "b")).alias("sig"), "a", "b", "bound").groupBy("sig").agg(F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("p"))
    near = promising(fingerprint_pairs(known.select("sig", "fp"), scratch), known, similarity).select("a", "b")
    tried = scratch.table(best.select("p.*").union(near).distinct(), "tried")
    links = scratch.table(verified(tried, reps, docs, width, similarity, scratch), "links")

    parts = connected_components(links, "a", "b", scratch)
    placed = scratch.table(shared.join(parts.withColumnRenamed("node", "sig"), "sig", "left").withColumn("part", F.coalesce("component", "sig")).drop("component"), "placed")
    mixed = placed.groupBy("shingle").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("shingle")
    # whatever two documents of different parts share is mixed, so the first shingle that they share has none before it
    before = Window.partitionBy("sig").orderBy("pos", "shingle").rowsBetween(-LOOK_BACK, -1)
    apart = scratch.table(placed.join(mixed, "shingle").withColumn("before", F.collect_list("shingle").over(before)), "apart")
    fresh = (F.col("a_part") < F.col("b_part")) & ~F.arrays_overlap("a_before", "b_before")
    rest = _pairs(_side(apart, "a", "part", "before").join(_side(apart, "b", "part", "before"), "shingle").where(fresh), similarity)
    rest = scratch.table(promising(rest.join(tried, ["a", "b"], "left_anti"), known, similarity), "rest")
    more = scratch.table(verified(rest, reps, docs, width, similarity, scratch), "more")

    parts = connected_components(links.union(more), "a", "b", scratch).withColumnRenamed("node", "sig")
    rooted = scratch.table(reps.join(parts, "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return signed.select("doc_id", "text_hash", "sig").join(rooted.join(least, "root").select("sig", F.col("root").alias("group"), "component_id"), "sig").select("doc_id", "text_hash", "group", "component_id")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar documents (see ``shingle_components``), with all its columns.

    The row with the group's smallest id stays, of rows repeated with that id one
    (``first_of_groups``); rows without an id stay.
    """
    return first_of_groups(docs, shingle_components(docs, width, similarity, id_col, text_col), id_col, text_col, Scratch(docs.sparkSession, "distinct"))
