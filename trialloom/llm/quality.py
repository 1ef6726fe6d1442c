"""Quality classifier: regularised quadratic discriminant on document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import LOWER, span_hashes, text_buffers, text_parts, word_spans

#: Shares are taken as log(share + FLOOR): most are near zero with a long tail. They count EXTRA more bytes or
#: words without hits, so that one capital or comma says little about a text of a few words.
FLOOR, EXTRA = 0.002, 40
#: The model is fitted on about so many labelled documents at most.
FIT_LABELS = 200_000

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "upper", "digit", "symbol", "marks", "punctuation", "other_space", "wide",
    "long_words", "marked_words", "upper_words", "same_as_last", "distinct_words", "one_byte_words", "bytes_a_line", "entropy",
)


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    digit = (code >= 48) & (code <= 57)
    letter = upper | ((code >= 97) & (code <= 122)) | (code >= 128)
    space = np.isin(code, [0x20, *range(0x09, 0x0E)])
    punctuation = np.isin(code, [ord(c) for c in ".,;:'\"?-()"])
    symbol = ~(letter | digit | space | punctuation)
    return {"upper": upper, "digit": digit, "symbol": symbol, "marks": code == ord("!"), "punctuation": punctuation, "other_space": space & (code != 0x20), "wide": code >= 128}


_CLASSES = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text; null and empty texts give finite rows too."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    share = lambda hits, of: np.log(hits / (of + EXTRA) + FLOOR)

    def by_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = {"log_bytes": np.log1p(size)}
    hit = {}
    for name, table in _CLASSES.items():
        hit[name] = by_row(table[raw])
        out[name] = share(hit[name], size)
    starts, ends, row = word_spans(raw, offsets)
    words = np.bincount(row, minlength=n)[:n]
    length = ends - starts
    per = lambda weight: np.bincount(row, weight, minlength=n)[:n]
    mean = per(length) / np.maximum(words, 1)
    out["log_words"] = np.log1p(words)
    out["word_bytes"] = np.log1p(mean)
    out["word_bytes_spread"] = np.log1p(np.sqrt(np.maximum(per(length.astype(float) ** 2) / np.maximum(words, 1) - mean**2, 0)))
    out["long_words"] = share(per(length > 24), words)
    out["one_byte_words"] = share(per(length == 1), words)
    tail = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out["marked_words"] = share(per(_CLASSES["symbol"][tail]), words)
    ups = np.concatenate([[0], np.cumsum(_CLASSES["upper"][raw], dtype=np.int64)])
    out["upper_words"] = share(per(ups[ends] - ups[starts] >= 2), words)
    h = span_hashes(LOWER[raw], starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out["same_as_last"] = share(per(again), words)
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order], fresh, minlength=n)[:n]
    # distinct words grow as a power of the words
    out["distinct_words"] = np.log1p(distinct) / np.log1p(np.maximum(words, 1))
    lines = by_row(raw == 0x0A) + 1
    out["bytes_a_line"] = np.log1p(size / lines)
    filled = np.maximum(size, 1)[:, None]
    kinds = np.stack([hit[k] for k in ("upper", "digit", "symbol", "punctuation", "other_space", "wide")], axis=1) / filled
    rest = np.maximum(1 - kinds.sum(axis=1), 0)
    p = np.concatenate([kinds, rest[:, None]], axis=1)
    out["entropy"] = -(p * np.log(p + 1e-9)).sum(axis=1)
    return np.stack([out[f] for f in FEATURES], axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants of shrunk covariances."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_det: np.ndarray | None = None
    temper: float = 1.0

    @staticmethod
    def fit(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, shrink: float, ridge: float) -> Discriminant:
        """From each class's row count, sums and sums of products."""
        total = n.sum()
        k = s1.shape[1]
        if total == 0:
            return Discriminant(0.5, np.zeros(k), np.ones(k))
        prior = float((n[1] + 1) / (total + 2))
        centre = s1.sum(axis=0) / total
        scale = np.sqrt(np.maximum(np.diag(s2.sum(axis=0)) / total - centre**2, 1e-6))
        if n.min() < 2:
            return Discriminant(prior, centre, scale)
        raw = s1 / n[:, None]
        own = np.stack([(s2[c] / n[c] - np.outer(raw[c], raw[c])) / np.outer(scale, scale) for c in (0, 1)])
        pooled = (own * n[:, None, None]).sum(axis=0) / total
        # small classes lean more on the pooled covariance
        weight = shrink + (1 - shrink) * k / (k + n)
        cov = (1 - weight)[:, None, None] * own + weight[:, None, None] * pooled + ridge * np.eye(k)
        chol = np.linalg.cholesky(cov)
        whiten = np.stack([np.linalg.inv(c) for c in chol])
        log_det = np.array([2 * np.log(np.diag(c)).sum() for c in chol])
        return Discriminant(prior, centre, scale, (raw - centre) / scale, whiten, log_det, float(np.sqrt(k)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; correlated statistics overstate the evidence, so it is tempered."""
        base = np.log(self.prior / (1 - self.prior))
        if self.means is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        density = [-0.5 * (((z - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(base + (density[1] - density[0]) / self.temper, -50, 50)))


def _parts(batches, text_col: str):
    for part in text_parts(batches, text_col):
        yield part, statistics(part.column(part.schema.get_field_index(text_col)))


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, shrink: float = 0.1, ridge: float = 0.01, fit_labels: int = FIT_LABELS, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fit on the rows of ``labels`` (doc_id, quality 0 or 1) for which ``use`` of doc_id holds.

    Of more than ``fit_labels`` different (doc_id, quality) a sample of about so
    many is taken, by hash of the id; equal rows count as often as they occur.
    Only labelled texts are read closely: the labels are sent to where the texts
    are. Tasks send on counts, sums and sums of products: two small rows each.
    """
    k = len(FEATURES)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & use).groupBy("doc_id", F.col("quality").cast("int").alias("_quality")).agg(F.count("*").alias("_times"))
    n = known.count()
    if n > fit_labels:
        known = known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(n)) < fit_labels)

    def sums(batches):
        n, s1, s2 = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
        for part, x in _parts(batches, "_text"):
            y, times = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("_quality", "_times"))
            for c in (0, 1):
                z, w = x[y == c], times[y == c, None]
                n[c] += w.sum()
                s1[c] += (w * z).sum(axis=0)
                s2[c] += (w * z).T @ z
        for c in (0, 1):
            flat = np.concatenate([[n[c]], s1[c], s2[c].ravel()])
            yield pa.RecordBatch.from_pydict({"c": pa.array([c] * len(flat), pa.int32()), "i": pa.array(range(len(flat)), pa.int32()), "v": flat})

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "doc_id")
    parts = texts.select("_text", "_quality", "_times").mapInArrow(sums, "c int, i int, v double")
    flat = np.zeros((2, 1 + k + k * k))
    for r in parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + k + k * k) numbers
        flat[r.c, r.i] = r.v
    return Discriminant.fit(flat[:, 0], flat[:, 1 : 1 + k], flat[:, 1 + k :].reshape(2, k, k), shrink, ridge)


def score_quality(docs: DataFrame, labels: DataFrame, use: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, predicted) for every row of ``docs``.

    A quadratic discriminant on statistics of the whole text: shares of kinds of
    bytes and words, repeats, lengths, each on a log scale. Class covariances are
    shrunk towards the pooled one and get a ridge. The score is the logistic of
    the tempered difference of log-densities plus the log prior odds; predicted
    is 1 at ``threshold`` or more. Only the text is an input of a score.

    Null and empty texts have the statistics of an empty text and get a score
    like any other. A null doc_id is scored but never learned from. Labels other
    than 0 and 1 are ignored, repeated rows count as often as they occur. Without
    labels of both classes all scores are the smoothed share of label 1 (0.5 with
    none). Other columns are ignored; an empty table gives no rows.
    """
    model = fit_quality(docs, labels, use, id_col=id_col, text_col=text_col)

    def run(batches):
        for part, x in _parts(batches, "text"):
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, use: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with all their columns.

    Model, scores and edge cases are those of ``score_quality``; texts stay where
    they are and are judged row by row.
    """
    model = fit_quality(docs, labels, use, id_col=id_col, text_col=text_col)

    def run(batches):
        for part, x in _parts(batches, text_col):
            yield part.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
