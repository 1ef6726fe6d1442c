"""Byte-balanced shards by histogram sort, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch

#: Bits by which a round of the histogram refines a key.
ROUND_BITS = 12
#: A slice of a shard with more than so many rows, and than DEAL_SLICES mean slices, is dealt to more tasks.
DEAL_ROWS, DEAL_SLICES = 500, 4


KEYS = ("h", "g", "u")


class Splitters:
    """Key boundaries between shards: a row is in the shard with as many boundaries at or below its key.

    Boundaries are triples (hash of the text, hash of the id, ordinal of a
    repeated row), compared in order.
    """

    def __init__(self, bounds: list[tuple[int, ...]]):
        self.bounds = bounds

    def shard(self) -> Column:
        out = F.lit(0)
        for b, (x, y, z) in enumerate(self.bounds):
            h, g, u = (F.col(k) for k in KEYS)
            out = F.when((h > x) | ((h == x) & ((g > y) | ((g == y) & (u >= z)))), b + 1).otherwise(out)
        return out.cast("int")


LEAST, SPAN = -(2**63), 2**64


@dataclass(frozen=True)
class Cell:
    """Keys whose first parts equal ``fixed`` and whose next part is one of ``width`` values from ``start`` on."""

    fixed: tuple[int, ...] = ()
    start: int = LEAST
    width: int = SPAN

    @property
    def step(self) -> int:
        return max(0, self.width.bit_length() - 1 - ROUND_BITS)

    def holds(self) -> Column:
        inside = F.col(KEYS[len(self.fixed)]).between(self.start, self.start + self.width - 1)
        for k, v in zip(KEYS, self.fixed):
            inside = (F.col(k) == v) & inside
        return inside

    def place(self) -> Column:
        return F.shiftright(KEYS[len(self.fixed)], self.step)

    def within(self, edge: int) -> Cell | None:
        """The part from ``edge`` on, as wide as one step; a single value is opened by the next part of the key."""
        if self.step:
            return Cell(self.fixed, edge, 1 << self.step)
        return Cell((*self.fixed, edge)) if len(self.fixed) + 1 < len(KEYS) else None

    def boundary(self, at: int) -> tuple[int, ...]:
        """The least key at or above ``at``."""
        fixed = self.fixed
        while at >= 2**63 and fixed:
            fixed, at = fixed[:-1], fixed[-1] + 1
        return (*fixed, at, *[LEAST] * len(KEYS))[: len(KEYS)] if at < 2**63 else (2**63 - 1,) * len(KEYS)


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> tuple[Splitters, list[tuple[int, int]]]:
    """Probe key boundaries until every splitter meets the tolerance.

    A round cuts the open cell around each splitter into 2**12 equal cells of
    the key and counts the exact bytes in each over all partitions. The boundary
    whose bytes below come nearest to the target wins, unless it is still off by
    more than ``tolerance`` of a shard; then the cell it lies in is opened
    again. A single text hash too large for the tolerance is opened by the hash
    of the id, and one id's repeated text by its rows' ordinals. The driver sees
    at most 4096 counts a splitter and round. Also returns the (text, id) hashes
    whose rows straddle a splitter beyond the tolerance for want of ordinals, at
    most one a splitter.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / shards
    found: dict[int, tuple[int, ...]] = {}
    straddling: set[tuple[int, int]] = set()
    cells = {s: (Cell(), 0) for s in range(1, shards)}  # and the bytes below the cell
    while cells:
        opened = list(dict.fromkeys(c for c, _ in cells.values()))
        cell, place = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, c in enumerate(opened):
            cell, place = F.when(c.holds(), n).otherwise(cell), F.when(c.holds(), c.place()).otherwise(place)
        counted = rows.select(cell.alias("cell"), place.alias("place"), "size").where("cell is not null").groupBy("cell", "place").agg(F.sum("size").alias("bytes")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(counted):
            by.setdefault(r.cell, []).append((r.place, r.bytes))
        after = {}
        for s, (c, below) in cells.items():
            target, at, inner = total * s / shards, c.start, None
            for place, size in by.get(opened.index(c), []):
                edge = place << c.step
                if below + size < target:
                    below, at = below + size, edge + (1 << c.step)
                    continue
                # the target lies in this part of the cell
                less, more = target - below, below + size - target
                inner = c.within(edge) if min(less, more) > slack else None
                if inner is None and min(less, more) > slack:
                    straddling.add(c.fixed)
                at = edge if less <= more else edge + (1 << c.step)
                break
            if inner:
                after[s] = (inner, below)
            else:
                found[s] = c.boundary(at)
        cells = after
    return Splitters([found[s] for s in range(1, shards)]), sorted(straddling)


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards hold nearly equal bytes, a row counting as the
    UTF-8 bytes of its text plus 1. Rows are sorted by hash of the text, then
    hash of the id, so copies of a text lie side by side, and are cut between
    shards only where their group straddles a boundary. Splitters come from
    ``find_splitters``; then rows are exchanged once, to slices of shards, and
    numbered within them. A slice's first slot is the exact count of the rows in
    the slices before it. Slices with many rows (a text with very many copies)
    are dealt to several tasks.

    Rows equal in id and text get an ordinal each, written with the row, as the
    last part of their key, if they straddle a boundary beyond the tolerance,
    however few they are, or are too many for one task's deal: they too are cut at
    boundaries and dealt to tasks. A null text counts as empty; a null
    id is hashed as null. The result's own columns replace columns of these names
    in ``docs``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in own]
    # the rows' own columns are held apart, so that no name clashes with the keys
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    hashed = docs.select(row, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col)).alias("g"), F.lit(0).cast("long").alias("u"))
    narrow = scratch.table(hashed.select(*KEYS, "size"), "keys")

    coarse = F.shiftright("h", 64 - ROUND_BITS).cast("int")
    sizes = scratch.table(narrow.groupBy(coarse.alias("slice")).agg(F.count("*").alias("n")), "sizes")  # 4096 rows at most
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deal = max(DEAL_ROWS, DEAL_SLICES * rows >> ROUND_BITS)
    full = F.broadcast(sizes.where(F.col("n") > deal).select("slice"))
    # at most as many as deals in the table
    tied = scratch.table(narrow.join(full, coarse == F.col("slice"), "left_semi").groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") > deal).select("h", "g"), "tied")
    ordinal = F.xxhash64(F.monotonically_increasing_id()).alias("u")
    if not tied.isEmpty():
        tied = F.broadcast(tied)
        again = scratch.table(hashed.join(tied, ["h", "g"], "left_semi").select("row", "size", "text_crc32", "h", "g", ordinal), "repeated")
        hashed = hashed.join(tied, ["h", "g"], "left_anti").select(again.columns).unionByName(again)
        narrow = scratch.table(narrow.join(tied, ["h", "g"], "left_anti").select(*KEYS, "size").unionByName(again.select(*KEYS, "size")), "keys")
    cut, straddling = find_splitters(narrow, shards, tolerance)
    if straddling:  # at most one group a splitter
        equal = F.lit(False)
        for h, g in straddling:
            equal = equal | ((F.col("h") == h) & (F.col("g") == g))
        again = scratch.table(hashed.where(equal).select("row", "size", "text_crc32", "h", "g", ordinal), "straddling")
        hashed = hashed.where(~equal).select(again.columns).unionByName(again)
        narrow = scratch.table(narrow.where(~equal).select(*KEYS, "size").unionByName(again.select(*KEYS, "size")), "keys")
        cut, _ = find_splitters(narrow, shards, tolerance)

    sliced = lambda df: df.withColumn("shard", cut.shard()).withColumn("slice", coarse)
    counts = scratch.table(sliced(narrow).groupBy("shard", "slice").agg(F.count("*").alias("n")), "slices")
    # at most 4096 slices and one more for each splitter
    deals = F.broadcast(counts.where(F.col("n") > deal).select("shard", "slice", F.ceil(F.col("n") / deal).cast("int").alias("deals")))
    spread = F.pmod(F.when(F.col("u") == 0, F.col("g")).otherwise(F.col("u")), F.coalesce("deals", F.lit(1)))
    dealt = lambda df: sliced(df).join(deals, ["shard", "slice"], "left").withColumn("deal", spread.cast("int"))
    pieces = scratch.table(dealt(narrow).groupBy("shard", "slice", "deal").agg(F.count("*").alias("n")), "pieces")
    before = Window.partitionBy("shard").orderBy("slice", "deal").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.table(pieces.select("shard", "slice", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    within = Window.partitionBy("shard", "slice", "deal").orderBy(*KEYS)
    # pieces: slices and at most 4096 / DEAL_SLICES more, joined after the exchange on its own keys
    numbered = dealt(hashed).withColumn("place", F.row_number().over(within)).join(first, ["shard", "slice", "deal"])
    return numbered.select(*[F.col("row")[c].alias(c) for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
