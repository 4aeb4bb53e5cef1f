"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line of a text that holds a word gives a vector of byte-level features; the chain's best labelling comes from
Viterbi decoding, and the share of words in content lines decides whether the text is kept. The field is fitted here
by maximum likelihood (forward-backward) on a bounded sample of labelled documents: a line counts as boilerplate if
its document is of low quality or if the line repeats an earlier one, else as content. That a line repeats is thus both
a reason for its label and a feature: the field learns that part by rote, and the rest from documents of low quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernel
from curatrix.llm.common import in_sample, one_text, sample_share, slices

#: At most about this many labelled documents fit the field, with all of their lines.
TRAIN_DOCS = 4_000
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
CONTENT_SHARE = 0.5
FEATURES = 12
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _PUNCT, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[list(b"!?{}[]()=_;@/\\~^+")] = True
_STOP[list(b".!?:\"')")] = True


def repeated_words(hashes: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words that lie in a run of k words found twice or more."""
    found = kernel.windows(hashes, k)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = np.zeros(len(found), bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    starts = order[same]
    if not len(starts):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Batch:
    """Counts and line features of the texts of one column."""

    def __init__(self, column: pa.Array):
        w = kernel.words(column, fold=False)
        data, offsets = w.data, w.offsets
        self.n = len(offsets) - 1
        total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        inside = ~kernel.SPACES[data]
        points = total(inside & ((data & 0xC0) != 0x80))
        symbols = total(_SYMBOLS[data])
        of = lambda sums, a, b: sums[b] - sums[a]
        self.n_words = np.diff(w.bounds)
        self.word_chars = of(points, offsets[:-1], offsets[1:])
        self.n_symbols = of(symbols, offsets[:-1], offsets[1:])
        self.n_repeat = np.array([repeated_words(w.hashes[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], np.int64).reshape(self.n)
        # Lines end at \n or at a text's end; only those with a word count.
        cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        starts, ends = cuts[:-1], cuts[1:]
        held = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
        starts, ends = starts[held > 0], ends[held > 0]
        self.words = held[held > 0].astype(np.float64)
        self.lines = np.searchsorted(starts, offsets)
        bodies = data != 10
        hashes = kernel.runs(data, offsets, bodies)
        line_hash = hashes.hashes[np.searchsorted(hashes.starts, starts)] if len(starts) else np.zeros(0, np.uint64)
        self.repeats = np.zeros(len(starts), bool)
        for a, b in zip(self.lines[:-1], self.lines[1:], strict=True):
            if b - a > 1:
                _, first = np.unique(line_hash[a:b], return_index=True)
                own = np.ones(b - a, bool)
                own[first] = False
                self.repeats[a:b] = own
        counts = total(self.repeats)
        self.n_dup_lines = of(counts, self.lines[:-1], self.lines[1:])
        # Features
        chars = np.maximum(of(points, starts, ends), 1).astype(np.float64)
        share = lambda mask: of(total(mask), starts, ends) / chars
        letters = chars * (1 - share(_SYMBOLS[data] | _DIGIT[data] | _PUNCT[data])) + 1
        first_word, last_word = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
        same = np.zeros(len(w.hashes), np.int64)
        same[1:] = w.hashes[1:] == w.hashes[:-1]
        again = total(same)
        last = w.ends[last_word - 1] - 1 if len(starts) else np.zeros(0, np.int64)
        f = np.zeros((len(starts), FEATURES))
        f[:, 0] = 1
        f[:, 1] = np.log1p(self.words)
        f[:, 2] = np.minimum(share(_SYMBOLS[data]) * 10, 3)
        f[:, 3] = np.minimum(of(total(_UPPER[data]), starts, ends) / letters, 1)
        f[:, 4] = share(_DIGIT[data]) * 5
        f[:, 5] = np.minimum(share(_PUNCT[data]) * 10, 3)
        f[:, 6] = self.repeats
        f[:, 7] = of(again, first_word, last_word) / self.words
        f[:, 8] = _STOP[data[last]] if len(starts) else 0
        f[:, 9] = chars / self.words / 10
        f[:, 10] = self.words < 4
        doc = np.repeat(np.arange(self.n), np.diff(self.lines))
        f[:, 11] = np.minimum(self.n_repeat[doc] / np.maximum(self.n_words[doc], 1), 1) if len(starts) else 0
        self.features = f

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat > MAX_REPEAT_PERCENT * self.n_words)


def viterbi(unary: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The best labelling of a chain: unary (n, 2), joint (2, 2); ties go to the smaller label."""
    n = len(unary)
    if not n:
        return np.zeros(0, np.int64)
    back = np.zeros((n, 2), np.int64)
    a, b = float(unary[0, 0]), float(unary[0, 1])
    j00, j01, j10, j11 = (float(x) for x in joint.ravel())
    for i in range(1, n):
        a0, b0, a1, b1 = a + j00, b + j10, a + j01, b + j11
        back[i, 0], back[i, 1] = b0 > a0, b1 > a1
        a, b = max(a0, b0) + float(unary[i, 0]), max(a1, b1) + float(unary[i, 1])
    out = np.zeros(n, np.int64)
    out[-1] = b > a
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _padded(chains: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and where a line is."""
    longest = max(len(y) for _, y in chains)
    x, y = np.zeros((len(chains), longest, FEATURES)), np.zeros((len(chains), longest), np.int64)
    here = np.zeros((len(chains), longest), bool)
    for i, (f, labels) in enumerate(chains):
        x[i, : len(labels)], y[i, : len(labels)], here[i, : len(labels)] = f, labels, True
    return x, y, here


def _slope(w: np.ndarray, x: np.ndarray, y: np.ndarray, here: np.ndarray) -> np.ndarray:
    """The gradient of the labels' log likelihood, by forward-backward."""
    d, (n, longest) = FEATURES, y.shape
    seen = np.einsum("cld,cl->d", x, y * here)
    pairs = here[:, 1:]
    moved = np.array([((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for a in (0, 1) for b in (0, 1)], float)
    u = np.stack([np.zeros_like(here, float), x @ w[:d]], axis=-1)
    joint = w[d:].reshape(2, 2)
    ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    ahead[:, 0] = u[:, 0]
    for t in range(1, longest):
        ahead[:, t] = np.where(here[:, t, None], np.logaddexp(ahead[:, t - 1, :1] + joint[0], ahead[:, t - 1, 1:] + joint[1]) + u[:, t], ahead[:, t - 1])
    z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        nxt = behind[:, t + 1] + u[:, t + 1]
        behind[:, t] = np.where(here[:, t + 1, None], np.stack([np.logaddexp(nxt[:, 0] + joint[a, 0], nxt[:, 1] + joint[a, 1]) for a in (0, 1)], axis=-1), 0)
    p1 = np.exp(ahead[..., 1] + behind[..., 1] - z[:, None]) * here
    expected = np.zeros(4)
    for a in (0, 1):
        for b in (0, 1):
            q = ahead[:, :-1, a] + joint[a, b] + u[:, 1:, b] + behind[:, 1:, b] - z[:, None]
            expected[2 * a + b] = np.exp(np.where(pairs, q, -np.inf)).sum()
    return np.concatenate([seen - np.einsum("cld,cl->d", x, p1), moved - expected])


def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> np.ndarray:
    """Weights (label 1's features, then the joint scores 00, 01, 10, 11) that maximise the labels' likelihood, by Adam on whole chains, padded to those of about their length."""
    w = np.zeros(FEATURES + 4)
    if not chains:
        w[0] = 1.0
        return w
    groups: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for chain in chains:
        groups.setdefault(len(chain[1]).bit_length(), []).append(chain)
    buckets = [_padded(groups[k]) for k in sorted(groups)]
    total = sum(here.sum() for _, _, here in buckets)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        gradient = sum(_slope(w, *bucket) for bucket in buckets) / total - ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def content_share(batch: Batch, weights: np.ndarray) -> np.ndarray:
    """The share of each text's words in lines that the field labels content; 0 without words."""
    joint = weights[FEATURES:].reshape(2, 2)
    scores = batch.features @ weights[:FEATURES]
    out = np.zeros(batch.n)
    for i, (a, b) in enumerate(zip(batch.lines[:-1], batch.lines[1:], strict=True)):
        if b > a:
            labels = viterbi(np.stack([np.zeros(b - a), scores[a:b]], axis=1), joint)
            out[i] = (labels * batch.words[a:b]).sum() / batch.words[a:b].sum()
    return out


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own = Batch(part.column("text"))
            low = part.column("quality").to_numpy(zero_copy_only=False) == 0
            rows = [own.features[a:b].ravel().tolist() for a, b in zip(own.lines[:-1], own.lines[1:], strict=True)]
            labels = [(~(own.repeats[a:b] | low[i])).astype(int).tolist() for i, (a, b) in enumerate(zip(own.lines[:-1], own.lines[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.list_(pa.int64()))], names=["doc_id", "f", "y"])


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The field's weights from documents with a quality label: all, or a seeded sample of about TRAIN_DOCS.

    Chains are whole texts; an id counts once, by its least text. Without labels every line is content."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = sample_share(usable.count(), TRAIN_DOCS)
    sample = F.broadcast(usable.where(in_sample(F.col("doc_id"), share, 5)))  # about TRAIN_DOCS rows of two integers
    rows = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(in_sample(F.col("doc_id"), share, 5)).join(sample, "doc_id"), "doc_id", "quality")
    found = rows.mapInArrow(_training, "doc_id long, f array<double>, y array<long>").where("size(y) > 0").collect()
    found.sort(key=lambda r: (r.doc_id, len(r.y)))
    return fit([(np.array(r.f).reshape(-1, FEATURES), np.array(r.y)) for r in found])


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def quality_rules(docs: DataFrame, weights: np.ndarray, share: float = CONTENT_SHARE) -> DataFrame:
    """COLUMNS, a row for every input row.

    Null texts count as empty and fail; ids may be null or repeat. Texts of any length are decoded as one chain of all
    their lines, where ties go to the smaller label. An empty table gives no rows, and other columns
    are not read."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    weights = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = Batch(part.column("text"))
                failed, content = own.base_failed(), content_share(own, weights)
                columns = [own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.asarray(c, np.int64)) for c in columns), pa.array(failed), pa.array(content), pa.array(~failed & (content >= share))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)
