"""SentencePiece, WARC, packing, sharding against libraries and brute force."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.llm import packing, warc
from trialloom.llm.queries import op2_warc, op3_sharding, op4_packing, tokenizer_file
from trialloom.llm.sentencepiece_codec import Codec, decode_documents, encode_documents
from trialloom.llm.sharding import shard_documents
from tests.compare import duck, rows_of, sql_rows

ODD = ["", " ", "   ", " a", "a  b   c\n\td", "▁x ▁", "😀 ☃ <s> <unk> \x00", "x" * 300 + "the" * 100, "<0x41>", " " * 40, "naïve café 日本語", "\r\n\x85 ", "<|endoftext|> I'll we've"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_bpe_equals_library(texts, model):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), Codec(model)
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [own.decode(x) for x in got] == [library.decode(x.tolist()) for x in got]


def test_long_words_equal_library(model):
    """Words longer than a batch: windows that meet, windows that never share a piece, and lone characters."""
    import sentencepiece

    rng = np.random.default_rng(3)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), Codec(model)
    letters = [list("etaoinshr"), list("ab"), list("日本語中文的是不"), list("=-"), ["a"], list("aé☃😀")]
    texts = ["".join(rng.choice(s, n)) for s in letters for n in (1, 63, 64, 65, 97, 500, 4001)]
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [own.decode(x) for x in got] == [library.decode(x.tolist()) for x in got]
    alone = [own._viterbi(np.array([[ord(c) for c in "▁" + t]], np.uint32), np.array([len(t) + 1])) for t in texts[:14]]
    assert [int((n > 0).sum()) for _, n in alone] == [len(x) for x in got[:14]]


def test_small_memories_change_nothing(texts, model, monkeypatch):
    from trialloom.llm import sentencepiece_codec as sp

    texts = [t[:3000] for t in texts[:40]]
    expected = [x.tolist() for x in Codec(model).encode(texts)]
    for name, value in (("REMEMBERED_WORDS", 500), ("PAIR_BITS", 8), ("BATCH_CELLS", 1 << 14)):
        monkeypatch.setattr(sp, name, value)
    own = Codec(model)
    assert [x.tolist() for k in range(0, len(texts), 9) for x in own.encode(texts[k : k + 9])] == expected


def test_unigram_paths_are_best(texts, model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -math.log(2 - max(p.score, -1e6))
    raw = proto.SerializeToString()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), Codec(raw)
    got, expected = own.encode(texts), library.encode(texts)
    total = lambda ids: float(np.sum(own.scores[np.asarray(ids, int)]))

    def best(text):
        """Greatest total score of one text's pieces, by a plain loop."""
        text = "▁" + text.replace(" ", "▁")
        top = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - own.longest), end):
                if text[start:end] in by_text:
                    top[end] = max(top[end], top[start] + by_text[text[start:end]])
        return top[-1]

    by_text = {p.piece: p.score for p in proto.pieces if p.type == 1}
    for text, ids in [(t, i) for t, i in zip(texts, got) if t and t.isascii() and len(t) < 3000 and all(c.isalnum() or c == " " for c in t)][:40]:
        assert math.isclose(total(ids), best(text), rel_tol=1e-4, abs_tol=1e-3)
    assert all(math.isclose(total(a), total(b), rel_tol=1e-4, abs_tol=1e-3) for a, b in zip(got, expected))
    assert [own.decode(a) for a in got] == [library.decode(b) for b in expected]
    assert sum(a.tolist() == b for a, b in zip(got, expected)) > 0.9 * len(texts)  # others are ties


def test_sentencepiece_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")], "doc_id long, text string, ids string")
    file = tokenizer_file("piece_bpe_32k.model")
    rows = decode_documents(encode_documents(docs, file), file).collect()
    assert [(r.doc_id, len(r.ids), r.decoded) for r in rows] == [(1, 0, ""), (None, 2, "a b"), (2, 0, ""), (2, 0, "")]
    both = encode_documents(docs, file, decoded=True).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in both] == [(r.doc_id, r.ids, r.decoded) for r in rows]
    named = encode_documents(docs, file).withColumn("decoded", F.lit(5))  # the result's own column replaces it
    assert [r.decoded for r in decode_documents(named, file).collect()] == ["", "a b", "", ""]
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in decode_documents(none, file).collect()] == [None, ""]
    assert encode_documents(docs.limit(0), file).count() == 0


def test_warc_equals_sql(spark, sf_dir):
    from trialloom.llm.queries import ORACLE_SQL

    assert rows_of(op2_warc(spark, sf_dir)) == sql_rows(duck(sf_dir), ORACLE_SQL["op2_warc"])


def test_warc_edges(spark):
    long = "<p>" + "x" * 1200
    rows = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "u", long), (9, "v", long), (None, "w", long), (9, "v", long), (4, "é", "é" * 600), (5, "k", "short"), (6, "k", "short")]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, refers_to int, digest string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in got)
    assert kinds == [(-1, "revisit", 9), (1, "response", -1), (2, "response", -1), (3, "revisit", 9), (4, "response", -1), (5, "response", -1), (6, "response", -1), (9, "response", -1), (9, "response", -1)]
    by = {r.page_id: r for r in got}
    assert by[4].payload_bytes == 1200 and bytes(by[4].block).decode() == "é" * 600 and by[3].payload_bytes == len(long)
    assert by[1].payload_bytes == 0 and by[1].payload_digest == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archive_is_zstd_with_dictionary():
    import struct

    import zstandard

    records = [warc.warc_record(i, f"http://h/{i}", f"<html><body>page {i} {'common text ' * 30}</body></html>".encode(), "00" * 20, None) for i in range(200)]
    data = warc.write_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0
    assert list(warc.read_archive(data)) == records
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert zstandard.ZstdCompressionDict(dictionary).dict_id() != 0
    assert list(warc.read_archive(warc.write_archive(records[:1]))) == records[:1]
    assert list(warc.read_archive(warc.write_archive([]))) == []


def test_packing(spark, sf_dir):
    p = op4_packing(spark, sf_dir).toPandas()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    assert set(p.doc_id) == set(docs)
    for doc, part in p.sort_values("piece").groupby("doc_id"):
        ids = np.array([*t.encode(docs[doc], add_special_tokens=False).ids, 0], "<u4")
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        assert (part.length.iloc[1:] == 2048).all() and (len(ids) > 2048 or len(part) == 1)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length)] == part.ids_crc32.tolist()
    q = p.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all() and (q.offset + q.length).max() <= 2048
    assert p.sequence_id.nunique() <= math.ceil(p.length.sum() / 2048) * 1.02 + 1


def test_encoder_equals_tokenizers(texts):
    """Texts with special tokens' strings (in ODD) too: the tokenizer is used as its file is."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    run = packing.encoder(tokenizer_file())
    assert all(run(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)
    assert 50256 in run("a <|endoftext|> b").tolist()
    other = packing.encoder(tokenizer_file("word_bpe_49k.json"))
    assert other("hello there").tolist() == Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")).encode("hello there", add_special_tokens=False).ids


@pytest.mark.parametrize("lengths", [[8] * 5, [1] * 17, [5] * 4, [3, 5, 8, 2, 2, 4, 4], [7, 7, 7, 1, 1, 2], list(range(1, 9)) * 3])
def test_plan(lengths):
    histogram = np.bincount(lengths, minlength=9)
    plan = packing.make_plan(histogram, 8)
    assert plan.used.tolist() == histogram.tolist()
    assert math.ceil(sum(lengths) / 8) <= plan.sequences <= math.ceil(sum(lengths) / 8) + 2


def test_place_edges(spark):
    none = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert packing.place_pieces(none, 8).count() == 0
    twice = spark.createDataFrame([(1, 0, 3, 7), (1, 0, 3, 7), (None, 0, 3, 7), (2, 0, 8, 7)], "doc_id long, piece int, length long, offset int")
    rows = packing.place_pieces(twice, 8).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4 and all(r.offset + r.length <= 8 for r in rows)
    with pytest.raises(ValueError):
        packing.place_pieces(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    made = packing.sequences(packing.place_pieces(packing.tokenised_pieces(docs, tokenizer_file(), 8), 8)).collect()
    assert sorted(sum(([*np.frombuffer(r.ids, "<u4")] for r in made), [])).count(0) == 3
    assert all(len(r.ids) == 4 * sum(r.lengths) for r in made)


def check_shards(rows, docs, shards):
    assert sorted(r.doc_id or -1 for r in rows) == sorted(d[0] or -1 for d in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return {s: sum(r.size for r in part) for s, part in by.items()}


def test_sharding(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op3_sharding(spark, sf_dir).collect()
    size = check_shards(rows, docs, 8)
    text = dict(docs)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows)
    largest = max(r.size for r in rows)
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 2 * largest


def test_sharding_of_copies(spark):
    docs = [(i, "copy" if i % 2 else f"own {i}", "x") for i in range(4000)] + [(None, None, "x"), (7, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string")
    rows = shard_documents(df, 8).collect()
    size = check_shards(rows, docs, 8)
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8
    assert shard_documents(df.limit(0), 8).count() == 0
    assert {r.shard for r in shard_documents(df.limit(1), 8).collect()} <= set(range(8))


def test_sharding_of_repeated_rows(spark, monkeypatch):
    """A row that is a third of the table is cut at boundaries and dealt to tasks."""
    from trialloom.llm import sharding

    monkeypatch.setattr(sharding, "DEAL_ROWS", 100)
    docs = [(i, f"own text {i}") for i in range(2000)] + [(5000, "repeated")] * 1000 + [(None, None)] * 300
    df = spark.createDataFrame([(*d, k, "x", 1) for k, d in enumerate(docs)], "doc_id long, text string, h int, row string, U long")
    rows = shard_documents(df, 8).collect()
    size = check_shards(rows, docs, 8)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(x - mean) <= 0.001 * mean + 14 for x in size.values())
    assert sorted(r.h for r in rows) == list(range(len(docs)))


@pytest.mark.parametrize(("rows", "equal"), [(800, 100), (800, 200), (1200, 400), (3000, 450), (3000, 500)])
def test_sharding_cuts_few_repeated_rows(spark, rows, equal):
    """Rows equal in id and text, too few for a deal of their own, are cut where they straddle a boundary."""
    size = 100
    df = spark.createDataFrame([(5, "x" * (size - 1)) if i < equal else (1000 + i, f"{i:099d}") for i in range(rows)], "doc_id long, text string")
    got = shard_documents(df, shards=8).groupBy("shard").agg(F.sum("size").alias("size"), F.max("slot").alias("slot"), F.count("*").alias("n")).collect()
    assert len(got) == 8 and sum(r.n for r in got) == rows
    assert all(abs(r["size"] - rows * size / 8) <= size and r.slot == r.n - 1 for r in got)
