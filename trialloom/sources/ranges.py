"""Large CSV and JSON files read by byte ranges in parallel, though their records need what stands before them.

Spark's text source cuts files into ranges at a separator (line end, or closing
brace). A first pass sums up each range for either state that it may begin in,
inside or outside quotes; the ranges of a file are put together in order, which
gives each its true state; a second pass cuts records. Records that cross ranges
come out in parts, which are joined. A task holds one record at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import scratch

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]', re.DOTALL)
_SUM = [("file", pa.string()), ("start", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()), ("sum0", pa.int64()), ("sum1", pa.int64()), ("head", pa.string())]


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Texts between separators with their file, the start of their byte range and whether that is the whole file, in order within a range."""
    whole = F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    return spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), whole.alias("whole"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, start, further columns), texts) for each range of a task; texts must be used up before the next range."""
    rows = ((tuple(r[:-1]), r[-1]) for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def texts() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                value = ahead[1]
                ahead = next(rows, None)
                yield value

        own = texts()
        yield key, own
        for _ in own:
            pass


def _range_states(pieces: DataFrame, summarise: Callable[[int, Iterator[str]], dict]) -> DataFrame:
    """(file, start, inside, before, head) of each range: its true state, the sum over earlier ranges, the file's first character.

    A range that is a whole file begins outside quotes, after nothing; it is left out."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), texts in _by_range(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, **summarise(start, texts)}], pa.schema(_SUM))

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("before", pa.int64()), ("head", pa.string())])
        file, inside, before, head = None, False, 0, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != file:
                    file, inside, before, head = r["file"], False, 0, r["head"]
                out.append({"file": file, "start": r["start"], "inside": inside, "before": before, "head": head})
                inside, before = (r["end1"], before + r["sum1"]) if inside else (r["end0"], before + r["sum0"])
            yield pa.RecordBatch.from_pylist(out, shape)

    sums = pieces.where("not whole").drop("whole").mapInArrow(first, "file string, start long, end0 boolean, end1 boolean, sum0 long, sum1 long, head string")
    states = sums.repartition("file").sortWithinPartitions("file", "start").mapInArrow(in_order, "file string, start long, inside boolean, before long, head string")
    return _written(states, "ranges")


#: States of at most so many byte ranges are broadcast; with more, pieces are exchanged to their states.
BROADCAST_RANGES = 200_000


def _with_states(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces (file, start, inside, before, head, value) with their range's state, in the order that they were read in."""
    columns = ["file", "start", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("before", F.lit(0)).alias("before"), "head", "value"]
    if states.count() <= BROADCAST_RANGES:
        return pieces.join(F.broadcast(states), ["file", "start"], "left").select(*columns)
    placed = pieces.withColumn("_at", F.monotonically_increasing_id()).join(states.hint("shuffle_hash"), ["file", "start"], "left")
    return placed.repartition("file", "start").sortWithinPartitions("file", "start", "_at").select(*columns)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- CSV


def _ends_inside(line: str, inside: bool) -> bool:
    """Whether a line of CSV ends within quotes; a cell is quoted if it begins with a quote, quotes within are doubled."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            # the next cell that begins with a quote
            if not line.startswith('"', at):
                at = line.find(',"', at) + 1
                if not at:
                    return False
            at, inside = at + 1, True
        close = line.find('"', at)
        while close >= 0 and line.startswith('""', close):
            close = line.find('"', close + 2)
        if close < 0:
            return True
        at, inside = line.find(",", close + 1), False
        if at < 0:
            return False
        at += 1


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value): the records of CSV files with their whole text, numbered from 1 in each file.

    Line breaks within quotes belong to the record; records without a character
    are not counted. Files of any size are read by many tasks."""
    pieces = _pieces(spark, path, "\n")

    def summarise(start: int, texts: Iterator[str]) -> dict:
        ends, counts = [False, True], [0, 0]
        for t in texts:
            for h in (0, 1):
                was, ends[h] = ends[h], _ends_inside(t, ends[h])
                counts[h] += not ends[h] and (was or t.rstrip("\r") != "")
        return {"end0": ends[0], "end1": ends[1], "sum0": counts[0], "sum1": counts[1], "head": None}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("file", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])
        for (file, start, inside, before, _), texts in _by_range(batches):
            number, held, broken, out = before + 1, [], inside, []
            for t in texts:
                held.append(t)
                was, inside = inside, _ends_inside(t, inside)
                if inside:
                    continue
                if was or t.rstrip("\r") != "":
                    out.append({"file": file, "number": number, "start": start, "whole": not broken, "value": "\n".join(held)})
                    number += 1
                held, broken = [], False
                if len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, shape)
                    out = []
            if held:
                out.append({"file": file, "number": number, "start": start, "whole": False, "value": "\n".join(held)})
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)

    rows = _written(_with_states(pieces, _range_states(pieces, summarise)).mapInArrow(cut, "file string, number long, start long, whole boolean, value string"), "records")
    parts = rows.where("not whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))  # the parts of one record
    joined = parts.select("file", "number", F.array_join(F.transform("p", lambda x: x.value), "\n").alias("value"))
    return rows.where("whole").select("file", "number", "value").unionByName(joined).withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r\\z", ""), "\r\n", "\n"))


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files (header, quotes doubled in quotes) with _file and row_index, from 1 in each file, as one task would read them.

    All columns are texts; an empty cell is null, and so are cells that a short row
    lacks. A file's columns follow its own header; the result has those of
    all files (at most MOST_HEADERS different headers). An empty header cell is
    named by its place, and of two equal ones the last counts."""
    records = csv_records(spark, path)
    first = records.where("number = 1").select(F.col("file").alias("_file"), F.col("value").alias("_header"))  # one row a file
    headers = [r[0] for r in first.groupBy("_header").agg(F.min("_file").alias("f")).orderBy("f", "_header").limit(MOST_HEADERS + 1).collect()]
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different headers")
    named = {h: [c or f"_c{k}" for k, c in enumerate(_cells(h.lstrip("\ufeff")))] for h in headers}
    names = list(dict.fromkeys(c for h in headers for c in named[h]))
    place = {h: [names.index(c) for c in cells] for h, cells in named.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("_file", pa.string()), ("row_index", pa.int64()), *[(f"c{k}", pa.string()) for k in range(len(names))]])
        for b in batches:
            columns: list[list] = [[None] * b.num_rows for _ in names]
            for i, (header, text) in enumerate(zip(b.column("_header").to_pylist(), b.column("value").to_pylist())):
                for k, cell in zip(place[header], _cells(text)):
                    columns[k][i] = cell
            yield pa.RecordBatch.from_arrays([b.column("_file"), b.column("row_index"), *[pa.array(c, pa.string()) for c in columns]], schema=shape)

    body = records.where("number > 1").select(F.col("file").alias("_file"), (F.col("number") - 1).alias("row_index"), "value")
    body = body.join(first, "_file") if len(headers) > 1 else body.withColumn("_header", F.lit(headers[0] if headers else ""))
    out = body.select("_file", "row_index", "value", "_header").mapInArrow(split, ", ".join(["_file string", "row_index long", *[f"c{k} string" for k in range(len(names))]]))
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], "_file", "row_index")


#: Different headers that the files of one read may have.
MOST_HEADERS = 100


def _cells(record: str) -> list[str | None]:
    """One record's cells; null for an empty cell."""
    out: list[str | None] = []
    at = 0
    while True:
        if record.startswith('"', at):
            close = record.find('"', at + 1)
            while close >= 0 and record.startswith('""', close):
                close = record.find('"', close + 2)
            close = len(record) if close < 0 else close
            end = record.find(",", close + 1)
            end = len(record) if end < 0 else end
            out.append(record[at + 1 : close].replace('""', '"') + record[close + 1 : end] or None)
        else:
            end = record.find(",", at)
            end = len(record) if end < 0 else end
            out.append(record[at:end] or None)
        if end == len(record):
            return out
        at = end + 1


# ---------------------------------------------------------------- JSON


class JsonCutter:
    """Objects at one depth of a JSON document, from the texts between its closing braces."""

    def __init__(self, inside: bool, depth: int, base: int):
        self.inside, self.depth, self.base = inside, depth, base
        self.held: list[str] = []
        self.begun = depth  # depth where the held text begins

    def move(self, piece: str) -> bool:
        """Take a text and the brace after it; whether the brace closes an object at the depth."""
        parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        for t in parts[1::2] if self.inside else parts[::2]:
            self.depth += t.count("{") + t.count("[") - t.count("]")
        self.inside ^= len(parts) % 2 == 0
        self.held.append(piece)
        if self.inside:
            return False
        self.depth -= 1
        return self.depth == self.base

    def take(self) -> str:
        """The held text with its last brace."""
        text, self.held, self.begun = "}".join(self.held) + "}", [], self.depth
        return text


def _lead(text: str, depth: int, base: int) -> tuple[str | None, str | None, str | None]:
    """(section, key, object) of a text that begins between objects: the last key at the top, the object's own key, its text."""
    section, key, last = None, None, None
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t[0] == '"':
            last = t
        elif t == ":":
            if depth == 1 and base == 2:
                section, key = json.loads(last, strict=False), None
            elif depth == base:
                key = json.loads(last, strict=False)
        elif t in "{[":
            if t == "{" and depth == base:
                return section, key, text[m.start() :]
            depth += 1
        elif t in "}]":
            depth -= 1
        elif depth == base:
            key = None
    return section, key, None


_PART = [("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("depth", pa.int64()), ("base", pa.int64()), ("section", pa.string()), ("key", pa.string()), ("value", pa.string())]
_PART_DDL = "file string, start long, n long, kind string, depth long, base long, section string, key string, value string"


def _head(texts: Iterator[str]) -> tuple[str | None, Iterator[str]]:
    """The first character that is no white space, and the texts from the first on."""
    held: list[str] = []
    for t in texts:
        held.append(t)
        first = t.lstrip("\ufeff \t\r\n")[:1]
        if first:
            return first, chain(held, texts)
    return None, iter(held)


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, section, key, value): the objects in JSON documents, in order of (start, n) within a file.

    Of a document that is a list these are its objects (section and key null); of
    one that is an object those in its lists and objects, ``section`` being their
    key at the top and ``key`` their own key in an object. Values that are no
    objects are passed over. Objects are texts: only one is held at a time, and a
    document of any size is read by many tasks."""
    pieces = _pieces(spark, path, "}")

    def summarise(start: int, texts: Iterator[str]) -> dict:
        # state and depth for a range that begins outside a string, and inside one
        two, head = (JsonCutter(False, 0, -(1 << 40)), JsonCutter(True, 0, -(1 << 40))), None
        for t in texts:
            if start == 0 and not head:
                head = t.lstrip("﻿ \t\r\n")[:1] or None
            for cutter in two:
                cutter.move(t)
                cutter.held.clear()
        return {"end0": two[0].inside, "end1": two[1].inside, "sum0": two[0].depth, "sum1": two[1].depth, "head": head}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, inside, before, head), texts in _by_range(batches):
            if head is None and start == 0:
                head, texts = _head(texts)
            base = 1 if head == "[" else 2
            cutter = JsonCutter(inside, before, base)
            row = {"file": file, "start": start, "base": base}
            broken, n, out = inside or before > base, 0, []
            for t in texts:
                if not cutter.move(t):
                    continue
                depth, text = cutter.begun, cutter.take()
                if broken:
                    out.append({**row, "n": n, "kind": "part", "depth": depth, "value": text})
                else:
                    section, key, value = _lead(text, depth, base)
                    out.append({**row, "n": n, "kind": "whole", "section": section, "key": key, "value": value})
                broken, n = False, n + 1
                if len(out) > 500:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(_PART))
                    out = []
            if cutter.held:
                clean = not cutter.inside and cutter.depth <= base and not broken
                text = "}".join(cutter.held)
                if clean:  # what follows the last object may name the next section
                    section, _, _ = _lead(text, cutter.begun, base)
                    out.append({**row, "n": n, "kind": "mark", "section": section})
                else:
                    out.append({**row, "n": n, "kind": "part" if broken else "tail", "depth": cutter.begun, "value": text + "}"})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(_PART))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                section, key, value = _lead(r["value"], r["depth"], r["base"])
                out.append({**r, "kind": "whole" if value is not None else "mark", "section": section, "key": key, "value": value})
            yield pa.RecordBatch.from_pylist(out, pa.schema(_PART))

    rows = _written(_with_states(pieces, _range_states(pieces, summarise)).mapInArrow(cut, _PART_DDL), "objects")
    parts = rows.where("kind in ('part', 'tail')")  # at most two a range
    begun = F.sum((F.col("kind") == "tail").cast("int")).over(Window.partitionBy("file").orderBy("start", "n"))
    chained = parts.withColumn("_chain", begun).groupBy("file", "_chain").agg(F.array_sort(F.collect_list(F.struct("start", "n", "depth", "base", "value"))).alias("p"))
    first = F.col("p")[0]
    whole = chained.select("file", first["start"].alias("start"), first["n"].alias("n"), F.lit("whole").alias("kind"), first["depth"].alias("depth"), first["base"].alias("base"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("key"), F.array_join(F.transform("p", lambda x: x.value), "").alias("value"))
    every = rows.where("kind in ('whole', 'mark')").unionByName(whole.mapInArrow(join, _PART_DDL))
    # a range's objects before its first named section belong to the last one named before
    named = every.where("section is not null").groupBy("file", "start").agg(F.max_by("section", "n").alias("_last"), F.min("n").alias("_first"))
    ranges = every.select("file", "start").distinct().join(named, ["file", "start"], "left")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.select("file", "start", F.last("_last", ignorenulls=True).over(earlier).alias("_given"))  # one row a range
    inherited = every.where("kind = 'whole' and value is not null").join(known, ["file", "start"], "left")
    return _filled_sections(inherited, every).select("file", "start", "n", "section", "key", "value")


def _filled_sections(objects: DataFrame, every: DataFrame) -> DataFrame:
    """Each object's section: its own, else the last that was named before it in its range, else the one given to the range."""
    named = every.where("section is not null").select("file", "start", F.col("n").alias("_n"), F.col("section").alias("_named"))
    turns = named.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("_n", "_named"))).alias("_turns"))  # sections of a document that begin in one range
    at = objects.join(turns, ["file", "start"], "left")
    before = F.filter(F.coalesce("_turns", F.array().cast("array<struct<_n:bigint,_named:string>>")), lambda t: t["_n"] <= F.col("n"))
    return at.withColumn("section", F.coalesce(F.try_element_at(before, F.lit(-1))["_named"], "_given"))
