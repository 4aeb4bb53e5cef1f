"""Document quality by co-training two views.

The content view sees the text alone (byte shares, repetition, word lengths), the metadata view sees length, language
and source alone. Over several rounds each view's classifier labels all unlabelled documents and hands the documents it is
surest of to the other view's training set. Both are calibrated on labelled rows that neither trained on, and a
logistic combination of the calibrated views scores every document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernel
from curatrix.llm.common import cut, in_sample, one_text, release, sample_share, slices
from curatrix.llm.linecrf import repeated_words
from curatrix.llm.toxicity import fit_logistic

#: Bound of the seeded sample of labelled rows, and of the unlabelled rows that a view labels one way in a round.
LABELLED_ROWS, TAKEN_ROWS = 8_000, 800
ROUNDS, CONFIDENT, SHARE_PER_ROUND = 4, 0.95, 0.1
LANG_BUCKETS, SOURCE_BUCKETS = 8, 32
CONTENT = 128 + 8
META = 3 + LANG_BUCKETS + SOURCE_BUCKETS
DOCUMENT = ("text", "lang", "source", "n_chars")


def content_features(column: pa.Array) -> np.ndarray:
    """A row per text: square roots of byte shares (one for all bytes beyond ASCII) and shares of repetition."""
    w = kernel.words(column, fold=False)
    out = np.zeros((len(w.offsets) - 1, CONTENT))
    for i in range(len(out)):
        data, own = w.data[w.offsets[i] : w.offsets[i + 1]], w.hashes[w.bounds[i] : w.bounds[i + 1]]
        if not len(data):
            continue
        counts = np.bincount(data, minlength=256)
        out[i, :127] = np.sqrt(counts[:127] / len(data))
        out[i, 127] = np.sqrt(counts[128:].sum() / len(data))
        n = max(len(own), 1)
        distinct = len(np.unique(own))
        same = np.count_nonzero(own[1:] == own[:-1])
        upper = counts[65:91].sum() / max(counts[65:91].sum() + counts[97:123].sum(), 1)
        out[i, 128:] = [1, np.log1p(len(own)) / 10, distinct / n, same / n, repeated_words(own) / n, upper, min(len(data) / n / 10, 3), min(np.log1p(n / max(distinct, 1)), 3)]
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """A row per document: log length and one-hot buckets of language and source; nulls have buckets of their own."""
    out = np.zeros((len(lang), META))
    bucket = lambda x, n: 0 if x is None else 1 + sum(x.encode()) * 2654435761 % (n - 1)
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        size = np.log1p(max(n or 0, 0)) / 10
        out[i, :3] = size, size * size, n is None
        out[i, 3 + bucket(a, LANG_BUCKETS)] = 1
        out[i, 3 + LANG_BUCKETS + bucket(b, SOURCE_BUCKETS)] = 1
    return out


def both_views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return content_features(part.column("text")), meta_features(*(part.column(c).to_pylist() for c in DOCUMENT[1:]))


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of both views, and their combination."""
        a = logit(logit(content, self.content)[:, None], self.calibration[0])
        b = logit(logit(meta, self.meta)[:, None], self.calibration[1])
        return sigmoid(a), sigmoid(b), sigmoid(logit(np.stack([a, b], axis=1), self.combination))


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], pool: DataFrame | None) -> Model:
    """labelled: content, metadata and labels; a seeded quarter of the rows calibrates. pool: rid, doc_id, content and meta of all rows without labels."""
    x = labelled[:2]
    y = labelled[2].astype(float)
    held = np.random.Generator(np.random.PCG64(5)).permutation(len(y)) % 4 == 3
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        even = float(y.mean()) if len(y) else 1.0
        flat = np.array([0.0, 0.0, np.log((even + 1e-3) / (1 - even + 1e-3))])
        return Model(np.zeros(CONTENT + 1), np.zeros(META + 1), (np.array([1.0, 0.0]), np.array([1.0, 0.0])), flat)
    taught: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # for each view, its features of pool rows that the other view has labelled
    weights = [np.zeros(0), np.zeros(0)]
    rows = pool.count() if pool is not None else 0
    limit = min(TAKEN_ROWS, max(1, int(SHARE_PER_ROUND * rows)))
    for turn in range(ROUNDS + 1):
        for view in (0, 1):
            own = [taught[view][i] for i in sorted(taught[view])]
            features = np.vstack([x[view][~held], *[f for _, f in own]])
            weights[view] = fit_logistic(features, np.concatenate([y[~held], [label for label, _ in own]]))
        if turn == ROUNDS or not rows:
            break
        for view in (0, 1):
            for label in (1.0, 0.0):
                for r in _surest(pool, view, weights[view], label, limit):
                    taught[1 - view].setdefault(r.rid, (label, np.frombuffer(r.other, np.float32).astype(float)))
    plain = [logit(x[v][held], weights[v]) for v in (0, 1)]
    calibration = tuple(fit_logistic(z[:, None], y[held], ridge=0.01) for z in plain)
    calibrated = np.stack([logit(z[:, None], c) for z, c in zip(plain, calibration, strict=True)], axis=1)
    return Model(weights[0], weights[1], calibration, fit_logistic(calibrated, y[held], ridge=0.1))


def _sampled(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                content, meta = (x.astype(np.float32) for x in both_views(part))
                packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (content, meta)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *packed], names=[*columns, "content", "meta"])

    return run


def _surest(pool: DataFrame, view: int, weights: np.ndarray, label: float, limit: int) -> list:
    """Of the whole pool the rows that a view is surest to bear the label: rid and the other view's features."""
    own, other = ("content", "meta") if view == 0 else ("meta", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.float32).reshape(len(batch), len(weights) - 1)
            p = sigmoid(logit(features, weights))
            sure = p if label else 1 - p
            out = pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("other"), pa.array(sure)], names=["rid", "doc_id", "other", "sure"])
            yield out.filter(pa.array(sure >= CONFIDENT))

    found = pool.select("rid", "doc_id", F.col(own).alias("own"), F.col(other).alias("other")).mapInArrow(run, "rid long, doc_id long, other binary, sure double")
    return found.orderBy(F.desc("sure"), "doc_id", "other", "rid").limit(limit).collect()


def _documents(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows (all of them, or a seeded sample of about LABELLED_ROWS) and on what the views are surest of among all others. A labelled id counts once, by its least text."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = sample_share(usable.count(), LABELLED_ROWS)
    sample = F.broadcast(usable.where(in_sample(F.col("doc_id"), share, 21)))  # about LABELLED_ROWS rows of two integers
    picked = one_text(_documents(docs).where(in_sample(F.col("doc_id"), share, 21)).join(sample, "doc_id"), "doc_id", "quality")
    rows = picked.select("doc_id", "quality", *DOCUMENT).mapInArrow(_sampled(["doc_id", "quality"]), "doc_id long, quality int, content binary, meta binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.content)))
    # Features meet the labels and not texts, which are larger; the labels grow with the documents, so none is broadcast.
    others = _documents(docs).select("doc_id", *DOCUMENT).mapInArrow(_sampled(["doc_id"]), "doc_id long, content binary, meta binary")
    pool = cut(others.join(usable.select("doc_id").hint("merge"), "doc_id", "left_anti").withColumn("rid", F.monotonically_increasing_id()))
    array = lambda part, name, n: np.array([np.frombuffer(r[name], np.float32) for r in part], float).reshape(len(part), n)
    labelled = (array(rows, "content", CONTENT), array(rows, "meta", META), np.array([r.quality > 0 for r in rows], bool))
    model = co_train(labelled, pool)
    release(pool)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, content_score, meta_score, score), a row for every input row.

    Nulls in any column count as missing values of their own and empty texts as such; ids may be null or repeat.
    Whole texts count, however long; an empty table gives no rows; further columns are not read."""
    names = ["doc_id", "content_score", "meta_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(s) for s in model.scores(*both_views(part)))], names=names)

    return _documents(docs).mapInArrow(run, "doc_id long, content_score double, meta_score double, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score below `threshold`; columns as they are."""
    rows = _documents(docs, F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.select(["row"]).filter(pa.array(model.scores(*both_views(part))[2] >= threshold))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
