"""A regularised quadratic discriminant over document statistics, learnt from labelled rows.

Each class gets a mean and a covariance that is shrunk towards its diagonal and towards the pooled covariance. Scores
are logistic in the difference of the classes' Mahalanobis log-densities plus the log prior odds; the inverse
Cholesky factors are computed once and travel with the model. Statistics come from whole texts, in numpy; the sums
that the fit needs are added up in tasks, so all labelled rows count and a few numbers per task reach the driver.

Defined cases: a null or empty text has statistics of zero and gets a score; a null id is never labelled nor held out;
labels that are null are left out, and of several labels of one id the lowest counts; documents that repeat an id
each count for the fit; without two labelled rows of each class every score is the prior (0.5 without labels); a score
of just the bound is accepted (scores are rounded to six digits first); other columns are ignored by scored and handed
on by the filter; an empty table gives no rows. Texts are taken whole, whatever their length; a task holds one text, or
about 1 MB of shorter ones, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import pieces, small_batches, stored, thrifty, utf8
from quillgraph.llm.setjoin import bloom, spots

NAMES = ("bytes", "words", "word_length", "word_spread", "upper", "digits", "stops", "shouts", "marks", "bars", "wide", "feeds", "distinct", "repeated_lines", "doubled", "letters", "echo")
K = len(NAMES)
_CLASS = np.zeros(256, np.uint8)
for _c, _s in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"#$%&*@^~_=+\\/<>{}[]`", b"|", bytes(range(0xC2, 0x100)), b"\n", b"abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_s)] = _c


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of K transformed statistics for each text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    starts, ends, woff = W.find_words(raw, off)
    words = np.diff(woff).astype(float)
    sums = lambda x, o: (c := np.concatenate([[0], np.cumsum(x)]))[o[1:]] - c[o[:-1]]
    length = (ends - starts).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    mean = sums(length, woff) / per_word
    spread = np.sqrt(np.maximum(0, sums(length**2, woff) / per_word - mean**2))
    row = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(row * 10 + _CLASS[raw], minlength=10 * n).reshape(n, 10) if len(raw) else np.zeros((n, 10))
    share = lambda c, by=per_byte: np.log((kinds[:, c] + 0.2) / (by + 3))
    h = W.hash_words(raw, starts, ends)
    _, uo = W.unique_sets(h, woff)
    loff, roff = W.split_lines(raw, off)
    lw = np.searchsorted(starts, loff)
    full = np.diff(lw) > 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    key = W.mix((total[lw[1:]] - total[lw[:-1]]) ^ np.diff(lw).astype(np.uint64))[full]
    before = np.concatenate([[0], np.cumsum(full)])[roff]
    _, lo = W.unique_sets(key, before)
    lines = np.diff(before)
    echo = np.zeros(len(h), bool)
    if len(h) > 1:
        echo[1:] = (h[1:] == h[:-1]) & ~np.isin(np.arange(1, len(h)), woff)
    twice = np.zeros(len(raw), bool)
    if len(raw) > 1:
        twice[1:] = (raw[1:] == raw[:-1]) & (_CLASS[raw[1:]] != 9) & (_CLASS[raw[1:]] != 7)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), share(1), share(2), share(3, per_word), share(4, per_word), share(5, per_word), share(6, per_word),
            np.log((kinds[:, 7] + 0.5) / (per_byte + 1)), share(8, per_word), np.diff(uo) / per_word * np.log1p(words), np.log((lines - np.diff(lo) + 0.1) / (lines + 1)), np.log((sums(twice, off) + 0.1) / (per_byte + 1)), kinds[:, [1, 7, 9]].sum(1) / per_byte,
            np.log((sums(echo, woff) + 0.2) / (words + 3)),
        ],
        1,
    )


def batch_statistics(column: pa.Array) -> np.ndarray:
    raw, off = utf8(column)
    x = [statistics(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off)]
    return np.concatenate(x) if x else np.zeros((0, K))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id, x array<double> (the K statistics); only of documents whose id the Bloom filter wanted lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                key = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
                ok = np.ones(len(key), bool)
                for h in spots(key, len(bits.value) * 8):
                    ok &= (bits.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
                batch = batch.filter(pa.array(ok))
            x = batch_statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * K, pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(text_col), F.col(id_col).cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors, log determinants of both classes, and the log prior odds."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        density = [-0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) - 0.5 * self.logdet[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPER + self.prior, -30, 30)))


ACCEPT = 0.7
#: the statistics depend on one another, so log-density differences are divided by this
TEMPER = 4.0


def fit(rows: DataFrame, own: float = 0.7, flat: float = 0.1) -> Model:
    """rows: x array<double>, y int (0 or 1). A class's covariance counts own, the pooled one 1 - own; then flat is the
    share of the diagonal."""

    @thrifty
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + K + K * K))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, K)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    z = x[y == c]
                    total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([*total], pa.list_(pa.float64()))], ["c", "v"])

    parts = rows.select("x", F.col("y").cast("int").alias("y")).mapInArrow(sums, "c int, v array<double>")
    added = parts.select("c", F.posexplode("v")).groupBy("c", "pos").agg(F.sum("col").alias("s")).collect()
    total = np.zeros((2, 1 + K + K * K))
    for r in added:
        total[r["c"], r["pos"]] = r["s"]
    n = total[:, 0]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Model(np.zeros((0, K)), np.zeros((0, K, K)), np.zeros(0), prior)
    mean = total[:, 1 : 1 + K] / n[:, None]
    scatter = total[:, 1 + K :].reshape(2, K, K) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    factor, logdet = [], []
    for c in (0, 1):
        s = own * scatter[c] / n[c] + (1 - own) * pooled
        s = (1 - flat) * s + flat * np.diag(np.diag(s)) + 1e-3 * np.eye(K)
        low = np.linalg.cholesky(s)
        factor.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return Model(mean, np.stack(factor), np.array(logdet), prior)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, y of the rows that may be learnt from."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    return known.where(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id")))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the labelled rows that aren't held out, and the stored statistics of all documents."""
    small_batches(docs.sparkSession)
    x = stored(features(docs), "features")
    return fit(x.join(known_labels(labels), "doc_id")), x


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model, x = fitted(docs, labels)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, K)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.score(rows), 6))], ["doc_id", "score"])

    done = x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return done.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with their columns. Labelled documents' statistics come first, for the
    fit; then all documents' statistics and scores in one pass."""
    small_batches(docs.sparkSession)
    known = stored(known_labels(labels), "labels")
    wanted = bloom(known.select(F.col("doc_id").alias("k")), known.count())
    model = fit(stored(features(docs, text_col=text_col, wanted=wanted).join(known, "doc_id"), "labelled"))
    names = docs.columns
    at = names.index(text_col)
    kinds = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.round(model.score(batch_statistics(batch.column(at))), 6) >= ACCEPT))

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, kinds).toDF(*names)
