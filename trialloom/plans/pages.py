"""Queries on pages, events as map elements, and data-set planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.text import slugify
from trialloom.operators import datasets as ds
from trialloom.operators import geo
from trialloom.operators import pages as pg
from trialloom.plans.base import query, read

_TRACK = "('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'source')"
_NORM = f"""p AS (SELECT *, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['s', 'h', 'p', 'q']) AS r FROM pages),
  n AS (SELECT page_id, url, html, 'https://' || regexp_replace(lower(r.h), '^www\\.', '') || CASE WHEN r.p = '/' THEN '/' ELSE rtrim(r.p, '/') END
  || coalesce('?' || nullif(array_to_string(list_transform(list_filter(string_split(r.q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN {_TRACK}), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&'), ''), '') AS norm FROM p)"""


@query(f"WITH {_NORM} SELECT page_id, norm, 'https://h.org/?k=' || page_id || '+a+b%25&e=%C3%A9%2A~&x=' AS coded FROM n")
def normalize_url(spark, sf_dir):
    """The table's URLs, and one a page whose query is written in several ways."""
    odd = F.concat(F.lit("http://WWW.h.org/?k="), "page_id", F.lit("%20a+b%&ref=z&&e=%C3%A9*%7e&x&utm%5Fid=4#f"))
    return read(spark, sf_dir, "pages").select("page_id", pg.normalize_url("url").alias("norm"), pg.normalize_url(odd).alias("coded"))


@query(f"""WITH {_NORM}, h AS (SELECT norm FROM n WHERE page_id % 4 = 0), f AS (SELECT page_id, norm, row_number() OVER (PARTITION BY page_id % 7, norm ORDER BY page_id) AS k FROM n) SELECT page_id FROM f WHERE k = 1 AND norm NOT IN (SELECT * FROM h)""")
def filter_visited(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("query_id"), F.col("page_id").alias("pos"), "url", "page_id")
    return pg.filter_visited(p, p.where("page_id % 4 = 0").select(pg.normalize_url("url").alias("url"))).select("page_id")


@query(f"WITH {_NORM} SELECT page_id % 7 AS query_id, count(DISTINCT norm) AS skipped FROM n WHERE norm IN (SELECT norm FROM n WHERE page_id % 4 = 0) GROUP BY 1")
def count_skipped(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("query_id"), "url", "page_id")
    return pg.count_skipped(p, p.where("page_id % 4 = 0").select(pg.normalize_url("url").alias("url")))


_SIG = "s AS (SELECT doc_id, lang, source, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))[:2000]) AS signature, text FROM documents)"


@query(f"WITH {_SIG} SELECT doc_id, signature FROM s")
def content_signature(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", pg.content_signature("text").alias("signature"))


@query(f"WITH {_SIG} SELECT min(doc_id) AS doc_id, signature FROM s GROUP BY signature")
def dedupe_content(spark, sf_dir):
    return pg.dedupe_content(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "signature")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", pg.html_to_text("html").alias("text"))


@query()
def page_text(spark, sf_dir):
    """Structured texts of whole pages; tested against the plain text and hand-made pages."""
    return read(spark, sf_dir, "pages").select("page_id", pg.page_text("html", "url").alias("text"))


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, split_part(url, '://', 1) AS s, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
  a AS (SELECT page_id, host AS domain, s || '://' || host || href AS link FROM l WHERE starts_with(href, '/')) SELECT page_id, link, domain, true AS internal, count(*) > 0 AS found FROM a GROUP BY ALL""")
def extract_links(spark, sf_dir):
    links = pg.extract_links(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    return links.select("page_id", "link", "domain", "internal", (F.col("id") >= 0).alias("found"))


@query(f"""WITH {_SIG}, f AS (SELECT *, row_number() OVER (PARTITION BY source, signature ORDER BY doc_id) AS d FROM s WHERE text <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM f WHERE d = 1)
  SELECT source, doc_id, place::INTEGER AS place, length(text[:4000]) AS chars FROM k WHERE place <= 4""")
def top_pages(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("signature", pg.content_signature("text"))
    return pg.top_pages(d, "source", "doc_id", "text", "signature").select("source", "doc_id", "place", F.char_length("text").cast("long").alias("chars"))


def _elements(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    case = F.col("event_id") % 5
    v = F.round("value", 1).cast("string")
    height = F.when(case == 0, F.concat(v, F.lit(" m"))).when(case == 1, F.concat(v, F.lit(" ft"))).when(case == 2, F.lit("tall"))
    levels = F.when(case.isin(2, 3), (F.col("event_id") % 30).cast("string"))
    tags = F.map_filter(F.map_from_arrays(F.array(F.lit("height"), F.lit("building:levels"), F.lit("building")), F.array(height, levels, F.col("event_type"))), lambda k, x: x.isNotNull())
    lat = (F.col("event_id") % 90).cast("double")
    center = F.when(case == 0, F.struct((lat + 0.5).alias("lat"), lat.alias("lon")))
    return e.select(F.lit("way").alias("type"), F.col("event_id").alias("id"), lat.alias("lat"), (-lat).alias("lon"), center.alias("center"), tags.alias("tags"))


_ROWS = """b AS (SELECT event_id AS osm_id, (event_id % 90)::DOUBLE + CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0 END AS lat,
  CASE event_id % 5 WHEN 0 THEN round(value, 1) WHEN 1 THEN round(value, 1) * 0.3048::DOUBLE WHEN 2 THEN event_id % 30 * 3.0::DOUBLE WHEN 3 THEN event_id % 30 * 3.0::DOUBLE END AS height_m, event_id % 5 < 3 AS has_height_tag FROM events)"""


@query(f"WITH {_ROWS} SELECT * FROM b")
def building_rows(spark, sf_dir):
    return geo.building_rows(_elements(spark, sf_dir)).select("osm_id", "lat", "height_m", "has_height_tag")


@query(f"""WITH {_ROWS} SELECT count(*) AS total_buildings, count(height_m) AS height_available, count(height_m) / count(*)::DOUBLE AS coverage_ratio, round(avg(height_m), 6) AS mean_m, round(median(height_m), 6) AS median_m, min(height_m) AS min_m, max(height_m) AS max_m, round(stddev_samp(height_m), 6) AS std_m FROM b""")
def building_stats(spark, sf_dir):
    s = geo.building_stats(geo.building_rows(_elements(spark, sf_dir)))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_m", "median_m", "std_m")})


@query("""SELECT event_id, event_type AS kind, (event_id % 3 = 0)::VARCHAR AS odd, CASE WHEN event_id % 2 = 0 THEN '[1,2]' ELSE '' END AS list FROM events""")
def expand_json_column(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "odd": '), (F.col("event_id") % 3 == 0).cast("string"), F.when(F.col("event_id") % 2 == 0, ', "list": [1,2]').otherwise(""), F.lit(', "event_id": '), "event_id", F.lit("}"))
    cells, _ = ds.expand_json_column(e.select(payload.alias("payload_json"), "ts"))
    return cells.withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT l_suppkey AS topic, l_linenumber AS sample FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity::INTEGER) >= 20")
def completed_samples(spark, sf_dir):
    return ds.completed_samples(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_linenumber").alias("sample"), F.col("l_quantity").cast("int").cast("string").alias("h")), 20, "topic", "sample", "h")


_DONE = "c AS (SELECT l_suppkey AS topic, l_linenumber AS sample FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity::INTEGER) >= 20), g AS (SELECT DISTINCT s_suppkey AS topic, s::INTEGER AS sample FROM supplier, generate_series(1, 9) t(s)), w AS (SELECT * FROM g EXCEPT SELECT * FROM c)"


def _pending(spark, sf_dir):
    topics = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("topic"))
    return ds.pending_samples(topics, 9, completed_samples(spark, sf_dir), "topic", "sample")


@query(f"WITH {_DONE} SELECT * FROM w")
def pending_samples(spark, sf_dir):
    return _pending(spark, sf_dir)


@query(f"WITH {_DONE} SELECT l_suppkey AS topic, l_linenumber AS sample, count(*) AS n FROM lineitem WHERE (l_suppkey, l_linenumber) NOT IN (SELECT topic, sample FROM w) GROUP BY ALL")
def drop_stale(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_linenumber").alias("sample"))
    return ds.drop_stale(r, _pending(spark, sf_dir), "topic", "sample").groupBy("topic", "sample").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, i::INTEGER AS artifact_index, 'a' || i || '-' || o_orderkey AS artifact FROM orders, generate_series(1, 3) t(i) WHERE i <= o_orderkey % 3 + 1")
def expand_records(spark, sf_dir):
    a = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("a"), i, F.lit("-"), "o_orderkey"))
    return ds.expand_records(read(spark, sf_dir, "orders").select("o_orderkey", a.alias("a")), "a")


@query("""WITH f AS (SELECT doc_id, lang || '/' || source || '/f' || doc_id % 50 || '.py' AS path FROM documents), k AS (SELECT * FROM f WHERE NOT starts_with(path, 'fr/') AND NOT starts_with(path, 'en/src1/') AND path <> 'en/src2/f2.py' AND NOT path LIKE '%/f7.py'),
  b AS (SELECT 0 AS src, doc_id AS ord, path FROM k UNION ALL SELECT 1, doc_id, path FROM f WHERE doc_id % 9 = 0) SELECT path, min({'src': src, 'ord': ord}).src AS src, min({'src': src, 'ord': ord}).ord AS ord FROM b GROUP BY path""")
def select_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    f = d.select(F.col("doc_id").alias("ord"), F.concat("lang", F.lit("/"), "source", F.lit("/f"), F.col("doc_id") % 50, F.lit(".py")).alias("path"))
    # rules are configuration
    rules = spark.createDataFrame([("fr/",), ("en/src1/",), ("en/src2/f2.py",), ("f7.py",), (" ",)], "rule string")
    return ds.select_files(f.where("ord % 9 = 0"), f, rules)


@query("SELECT doc_id, greatest(3, least(10, 3 + floor((len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) - 1) / 2)))::INTEGER AS n FROM (SELECT doc_id, text FROM documents)".replace("/ 2)", "/ 200)"))
def estimate_patch_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ds.estimate_patch_count(F.col("text")).alias("n"))


def _patches(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    case = F.col("doc_id") % 6
    path = F.concat(F.lit("src/"), "source", F.lit(".py"))
    body = F.concat(
        F.lit("*** Begin Patch\n"), F.when(case == 1, F.lit("*** Add File: x\n")).otherwise(""), F.lit(" *** Update File: "), F.when(case == 2, F.lit("other.py")).otherwise(path), F.lit("\n"),
        F.when(case == 3, F.lit("*** Update File: y\n")).otherwise(""), F.when(case == 4, F.lit("no edit\n")).otherwise("@@ -1 +1\n"), F.when(case == 5, "").otherwise(F.lit("*** End Patch")),
    )
    return d.select("doc_id", path.alias("file_path"), body.alias("patch"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'count differs' ELSE CASE doc_id % 6 WHEN 1 THEN 'not an update only' WHEN 2 THEN 'other path than expected' WHEN 3 THEN 'not exactly one update line' WHEN 4 THEN 'edit marker missing' WHEN 5 THEN 'begin or end marker missing' END END AS reason FROM documents""")
def validate_patches(spark, sf_dir):
    p = _patches(spark, sf_dir)
    bundles = p.select(F.col("doc_id").alias("bundle_id"), "file_path", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("asked"))
    rows = p.select(F.col("doc_id").alias("bundle_id"), F.lit(1).alias("ord"), F.lit("p").alias("problem"), F.lit("a").alias("answer"), "patch")
    return ds.validate_patches(bundles, rows).select(F.col("bundle_id").alias("doc_id"), "reason")


@query("""WITH t AS (SELECT doc_id, 0 AS pos, 'x' AS path FROM documents WHERE doc_id % 6 = 1 UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 6 = 2 THEN 'other.py' ELSE 'src/' || source || '.py' END FROM documents UNION ALL SELECT doc_id, 2, 'y' FROM documents WHERE doc_id % 6 = 3)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS place, path FROM t""")
def touched_paths(spark, sf_dir):
    return ds.touched_paths(_patches(spark, sf_dir), "doc_id", "patch")


_PLAN = "s AS (SELECT DISTINCT s_suppkey AS k FROM supplier), c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT k, coalesce(n, 0) AS recorded FROM s LEFT JOIN c USING (k) WHERE coalesce(n, 0) < 600)"


def _plan(spark, sf_dir):
    specs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_path"), F.lit(600).alias("needed"))
    return ds.plan_regeneration(specs, read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_path")))


@query(f"WITH {_PLAN} SELECT k AS file_path, recorded FROM t")
def plan_regeneration(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("file_path", "recorded")


@query(f"WITH {_PLAN} SELECT l_suppkey AS file_path, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT k FROM t WHERE recorded > 0) GROUP BY 1")
def kept_records(spark, sf_dir):
    return _plan(spark, sf_dir)[1].groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT item_id, (SELECT max(doc_id) FROM documents WHERE doc_id % 3 <> 0) + row_number() OVER (ORDER BY item_id) AS patch_index FROM benchmark")
def assign_patch_index(spark, sf_dir):
    names = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note"), F.col("doc_id") * 1000, F.lit(".txt"))).otherwise(F.concat(F.lit("patch_"), "doc_id", F.lit(".txt"))).alias("name"))
    return ds.assign_patch_index(names, read(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'scores do not sum to 10' WHEN 2 THEN 'integer score missing' WHEN 3 THEN 'requirement missing' ELSE 'question without search' END AS reason FROM documents""")
def validate_rubric(spark, sf_dir):
    case = F.col("doc_id") % 5
    item = lambda r, s: F.struct(r.alias("requirement"), s.alias("score"))
    items = F.array(item(F.when(case == 3, " ").otherwise("r1"), F.lit("4")), item(F.lit("r2"), F.when(case == 1, "5").when(case == 2, "6.5").otherwise("6")))
    question = F.when(case == 4, "Find it.").otherwise(F.lit("Search it."))
    return read(spark, sf_dir, "documents").select("doc_id", ds.validate_rubric(items, question).alias("reason"))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'topic') AS slug FROM pages""")
def slugify_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", slugify("url").alias("slug"))


@query("SELECT 25::BIGINT AS n FROM benchmark LIMIT 1")
def sample_problems(spark, sf_dir):
    return ds.sample_problems(read(spark, sf_dir, "benchmark"), 25, 4, "item_id").agg(F.countDistinct("item_id").alias("n"))


@query("SELECT item_id AS id, split_part(text, ' the ', 1) AS question, CASE WHEN item_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM benchmark")
def rename_split(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return ds.rename_split({"train": b.where("item_id % 2 = 0"), "test": b.where("item_id % 2 = 1")}, {"item_id": "id", "text": "question"}, " the ")


_PARA = "d AS (SELECT doc_id, list_filter(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10)) <> '') AS p FROM documents)"


def _paragraphs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))


@query(f"WITH {_PARA} SELECT doc_id, generate_subscripts(p, 1)::INTEGER AS number, unnest(p) AS paragraph FROM d")
def number_paragraphs(spark, sf_dir):
    return ds.number_paragraphs(_paragraphs(spark, sf_dir), "doc_id", "text")


@query(f"WITH {_PARA} SELECT doc_id, CASE WHEN len(p) >= 3 THEN p[1] || chr(10) || chr(10) || p[2] ELSE '' END AS before FROM d")
def text_before_paragraph(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", ds.text_before_paragraph(F.col("text"), 3).alias("before"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x = ' || doc_id END AS code FROM documents")
def fenced_block(spark, sf_dir):
    text = F.concat(F.lit("see ```js\nno\n``` and ```"), F.when(F.col("doc_id") % 2 == 0, "python").otherwise("sql"), F.lit("\n x = "), "doc_id", F.lit("\n```"))
    return read(spark, sf_dir, "documents").select("doc_id", ds.fenced_block(text, "python").alias("code"))
