"""Growing logs as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialloom.functions.folders import delete, scratch
from trialloom.functions.numbering import same_keys
from trialloom.operators.evaluation import ARMS, merge_stats, scores_of_stats, summary_of_sums, summary_sums
from trialloom.operators.pages import content_signature, normalize_url
from trialloom.sources.runs import STEP_SCHEMA
from trialloom.sources.store import BucketStore


def stream_json(spark: SparkSession, path: str, schema: str = STEP_SCHEMA, files_a_batch: int = 1000) -> DataFrame:
    """Follow JSON-lines logs as files arrive; bad lines go, as in the batch reader."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("mode", "DROPMALFORMED").json(path)


def dedupe_runs(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "7 days") -> DataFrame:
    """One record of each run key. With a time column state older than ``delay`` is forgotten, else it is kept for good."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def start_unseen_pages(stream: DataFrame, pages_table: str, history: str, checkpoint: str, order: list[str], url: str = "url", text: str = "text", buckets: int = 64):
    """Write pages whose normalised URL and content are new to ``pages_table``, a folder a batch.

    In each batch pages are visited in ``order``, which must tell them apart. A
    page is dropped if its URL has been visited; else its URL is recorded, and it
    is dropped if its content's signature is recorded, else that is recorded and
    the page stays. So where batches follow the order, the result is that of a
    single pass, however pages are split into batches. A null or blank URL stays
    as it is and counts as one URL.

    Both histories are tables of hashes in buckets. A batch reads and rewrites
    only the buckets of its own URLs and signatures. A batch that runs again
    starts from the version before it."""
    spark = stream.sparkSession
    urls = BucketStore(spark, f"{history}/urls", ["norm_url"], "norm_url string", buckets)
    contents = BucketStore(spark, f"{history}/contents", ["signature"], "signature string", buckets)

    def new_to(store: BucketStore, pages: DataFrame, batch_id: int) -> DataFrame:
        """The first page of each key that the store did not hold before this batch."""
        key = store.keys[0]
        before = [v for v in store.versions() if v < batch_id]
        first = pages.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
        if before:
            first = first.join(store.read(before[-1], store.touched(pages)), key, "left_anti")
        return pages.join(first.select("_first"), F.struct(*order) == F.col("_first"), "left_semi")

    def merge(batch: DataFrame, batch_id: int) -> None:
        path = scratch(spark, "pages")
        batch.withColumn("norm_url", normalize_url(url)).withColumn("signature", content_signature(F.coalesce(text, F.lit("")))).write.parquet(f"{path}/batch")
        pages = spark.read.parquet(f"{path}/batch")
        new_to(urls, pages, batch_id).write.parquet(f"{path}/by-url")
        visited = spark.read.parquet(f"{path}/by-url")
        new_to(contents, visited, batch_id).write.mode("overwrite").parquet(f"{pages_table}/batch={batch_id}")
        urls.upsert(visited, version=batch_id)
        contents.upsert(spark.read.parquet(f"{pages_table}/batch={batch_id}"), version=batch_id)
        delete(spark, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Statistics of a slice of a problem's trials.
STATS = ", ".join(f"{a}_n long, {a}_sum double, {a}_least double, {a}_most double" for a in ARMS)
_SLICE = ["problem_id", "slice"]


def last_trials(rows: DataFrame, slices: int, order: str | None = None) -> DataFrame:
    """Rows (problem_id, slice, arm, trial, score, valid): one for each trial of ``rows``.

    A problem's trials are dealt to ``slices`` by hash. Of several rows of a trial
    the last by ``order`` counts, then the greatest score (null is least) and
    feedback. A trial of score 0 without feedback is not valid."""
    score = F.when(~F.isnan(F.col("score").cast("double")), F.col("score").cast("double"))
    feedback = F.coalesce("feedback", F.lit(""))
    valid = ~((F.col("score") == 0) & (F.trim(feedback) == "")) | F.col("score").isNull()
    rank = F.struct((F.col(order) if order else F.lit(0)).alias("place"), score.isNotNull().alias("known"), F.coalesce(score, F.lit(0.0)).alias("score"), feedback.alias("feedback"), valid.alias("valid"))
    last = rows.groupBy("problem_id", "arm", "trial").agg(F.max(rank).alias("r"))
    return last.select("problem_id", F.pmod(F.xxhash64("arm", "trial"), F.lit(slices)).cast("int").alias("slice"), "arm", "trial", F.when(F.col("r.known"), F.col("r.score")).alias("score"), F.col("r.valid").alias("valid"))


def slice_stats(trials: DataFrame) -> DataFrame:
    """The statistics of each slice's trials."""
    out = [F.count("*").alias("trials")]
    for a in ARMS:
        own = F.when(F.col("arm") == a, F.col("score"))
        out += [F.count(own).alias(f"{a}_n"), F.sum(own).alias(f"{a}_sum"), F.min(own).alias(f"{a}_least"), F.max(own).alias(f"{a}_most")]
    return trials.groupBy(*_SLICE).agg(*out)


def _same(old: DataFrame, new: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on equal or both null keys."""
    names = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    return old.join(new.select(*names, *[c for c in new.columns if c not in keys]), same_keys(old, "_k", keys), how).drop(*[f"_k{n}" for n in range(len(keys))])


def start_summary(stream: DataFrame, state: str, summary_table: str, checkpoint: str, slices: int = 8, order: str | None = None, buckets: int = 64):
    """Keep the evaluation summary of all trials seen so far; ``summary_table`` gets one row a batch, with its ``batch``.

    Trials are (problem_id, arm, trial, score, feedback); a trial that comes again
    replaces its old score, and goes if it is no longer valid (``last_trials``).
    Valid trials are a table in buckets of slices, and so a problem of any size is
    spread; statistics of slices are a table in buckets of problems. A batch
    reads and rewrites the buckets of its own slices and problems. The summary is
    a row of sums over problems: what the batch's problems gave before is taken
    off, what they give now is added. So the work of a batch follows the buckets
    that it touches. A batch that runs again starts from the version before it."""
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    kind = kinds["problem_id"]
    held = BucketStore(spark, f"{state}/trials", _SLICE, f"problem_id {kind}, slice int, arm {kinds['arm']}, trial {kinds['trial']}, score double", buckets)
    table = BucketStore(spark, f"{state}/slices", ["problem_id"], f"problem_id {kind}, slice int, trials long, {STATS}", buckets)

    def sums(stats: DataFrame) -> DataFrame:
        return summary_sums(scores_of_stats(merge_stats(stats.where("trials > 0"), "problem_id"), "problem_id"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        path = scratch(spark, "slices")
        last_trials(batch, slices, order).write.parquet(f"{path}/trials")
        came = spark.read.parquet(f"{path}/trials")
        every = [*_SLICE, "arm", "trial"]
        touched = held.merge(came, lambda old, new: _same(old, new.select(*every), every, "left_anti").unionByName(new.where("valid").drop("valid")), batch_id)
        keys = came.select(*_SLICE).distinct()
        now = slice_stats(_same(held.read(batch_id, touched), keys, _SLICE, "left_semi"))
        none = {c: 0 for c in ["trials", *[f"{a}_n" for a in ARMS]]}
        _same(keys, now, _SLICE, "left").fillna(none).write.parquet(f"{path}/slices")
        changes = spark.read.schema(table.schema).parquet(f"{path}/slices")
        before = [v for v in table.versions() if v < batch_id]
        problems = changes.select("problem_id").distinct()
        own = lambda stats: _same(stats, problems, ["problem_id"], "left_semi")
        touched = table.merge(changes, lambda old, new: _same(old, new.select(*_SLICE), _SLICE, "left_anti").unionByName(new), batch_id)
        old = sums(own(table.read(before[-1], touched)) if before else spark.createDataFrame([], table.schema))
        new = sums(own(table.read(batch_id, touched)))
        names = new.columns
        parts = [new] + [old.select(*[(-F.col(c)).alias(c) for c in names])]
        if before:
            parts.append(spark.read.parquet(f"{state}/sums/batch={before[-1]}"))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole.agg(*[F.sum(c).alias(c) for c in names]).coalesce(1).write.mode("overwrite").parquet(f"{state}/sums/batch={batch_id}")
        summary_of_sums(spark.read.parquet(f"{state}/sums/batch={batch_id}")).coalesce(1).write.mode("overwrite").parquet(f"{summary_table}/batch={batch_id}")
        delete(spark, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_summary(spark: SparkSession, summary_table: str) -> DataFrame:
    """The summary after the last batch."""
    every = spark.read.parquet(summary_table)
    return every.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("batch")))).where("_n = 1").drop("_n", "batch")  # one row a batch


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append to a parquet table and read it."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
