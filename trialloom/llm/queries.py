"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.chat_format import digest_windows, format_windows
from trialloom.llm.collocations import collocations
from trialloom.llm.common import crc_of_id
from trialloom.llm.conversation_repair import damage_conversations, digest_repaired, repair_conversations
from trialloom.llm.embedding_dedup import near_duplicate_vectors
from trialloom.llm.exact_topk import exact_top_k
from trialloom.llm.packing import place_pieces, tokenised_pieces
from trialloom.llm.pitman_yor import score_texts
from trialloom.llm.quality import score_quality
from trialloom.llm.secrets import find_secrets
from trialloom.llm.sentencepiece_codec import encode_documents
from trialloom.llm.sharding import shard_documents
from trialloom.llm.simhash import simhash_components
from trialloom.llm.warc import archive_pages


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = encode_documents(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), decoded=True)
    words = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(words.cast("binary")).alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenised_pieces(_read(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place_pieces(digest, capacity=2048, order=("doc_id", "piece", "ids_crc32"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 10 == 0, F.lit(False))
    scored = score_texts(_read(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    scored = score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secret_spans", lambda s: s.kind != "random")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"), width=4, bits=4)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digest_windows(format_windows(rows.unionByName(probe), tokenizer_file(), budget=1024, history=256))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"), least=10, share=50, top=2000)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    report, repaired = repair_conversations(damage_conversations(rows))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    found = report.join(digest_repaired(repaired).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    out = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("id").alias("conv_id"), *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_chat_format": op11_chat_format,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
          CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN kept <> page_id THEN kept END AS refers_to FROM m""",
    "op10_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
              AND list_cosine_similarity(a.q, b.q) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
        SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op12_collocations": r"""
        WITH d AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
        g AS (
          SELECT lang, unnest(list_concat(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i]), list_transform(range(1, len(ws)), lambda i: ws[i:i+1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2]))) AS p FROM w),
        f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY 1, 2),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY 1),
        c AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2 AND f >= 10),
        cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
        scored AS (
          SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[k+1:]),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM scored) WHERE i = 1),
        inside AS (SELECT lang, p[1:2] AS p, a FROM c WHERE len(p) = 3 UNION ALL SELECT lang, p[2:3], a FROM c WHERE len(p) = 3),
        longer AS (SELECT lang, p, max(a) AS most FROM inside GROUP BY 1, 2),
        kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.p = b.p WHERE NOT coalesce(100 * most >= 50 * b.a, FALSE)),
        ranked AS (
          SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score,
            row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE
        crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
        hit AS (
          SELECT c.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 20 AS kind FROM conversations c, crc_table),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
          FROM hit WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
        judged AS (
          SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
        next_state AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(p, r, q)),
        inserted AS (
          SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')) v(p, q, cost, audit)),
        edits AS (
          SELECT conv_id, pos, s AS p, s AS q, 4 AS cost, 'D' AS audit FROM judged, range(4) x(s)
          UNION ALL SELECT conv_id, pos, p, q, CASE WHEN fault IS NULL THEN 0 ELSE 3 END, 'K' FROM judged JOIN next_state ON i = r WHERE coalesce(fault, '') IN ('', 'truncated')
          UNION ALL SELECT conv_id, pos, p, q, CASE WHEN fault IS NULL THEN 3 ELSE 6 END, 'R' FROM judged JOIN next_state ON r <> 's' WHERE coalesce(fault, '') IN ('', 'truncated')),
        steps AS (SELECT e.conv_id, e.pos, e.p, n.q, e.cost + n.cost AS cost, e.audit || n.audit AS audit FROM edits e JOIN inserted n ON e.q = n.p),
        sizes AS (SELECT conv_id, max(pos) AS n FROM placed GROUP BY 1),
        walk AS (
          SELECT conv_id, 0::BIGINT AS pos, i.q AS state, i.cost, i.audit FROM sizes, inserted i WHERE i.p = 0
          UNION ALL
          SELECT conv_id, pos, state, cost, audit FROM (
            SELECT s.conv_id, s.pos, s.q AS state, w.cost + s.cost AS cost, w.audit || s.audit AS audit,
              row_number() OVER (PARTITION BY s.conv_id, s.q ORDER BY w.cost + s.cost, w.audit || s.audit) AS best
            FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.p = w.state) WHERE best = 1),
        parsed AS (
          SELECT conv_id, cost, audit FROM (
            SELECT w.conv_id, cost, audit, row_number() OVER (PARTITION BY w.conv_id ORDER BY cost, audit) AS best
            FROM walk w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.pos WHERE state IN (0, 3)) WHERE best = 1),
        letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS k, length(replace(audit, 'D', '')) % 2 AS odd FROM parsed WHERE audit <> ''),
        numbered AS (
          SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w - 1 - odd AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        fixed AS (
          SELECT n.conv_id, n.k, CASE WHEN e = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
          FROM numbered n LEFT JOIN placed d ON d.conv_id IS NOT DISTINCT FROM n.conv_id AND d.pos = n.pos WHERE e <> 'D'),
        whole AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM fixed GROUP BY 1),
        beside AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM judged),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM beside GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
          coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN counts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN parsed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
