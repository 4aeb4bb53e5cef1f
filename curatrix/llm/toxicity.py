"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

Terms are learned: words, and word beginnings of four letters or more, that labelled toxic documents hold far more
often than clean ones. All the words form a trie. A word is matched by walking the trie together with the Levenshtein automata of all
terms at once: a state is a set of (trie node, automaton row) and is built when first reached, so a misspelled term
is found in one walk over the word and most words die after a few letters. A term's beginning matches exactly. What a
term weighs when misspelled is learned as well: less if what is near it also stands in clean training texts.

Each hit is weighed by its context, a window of words around it: whether the nearest quotation marks there enclose it,
or a word reports speech. Counts of plain, quoted, reported and misspelled hits go into a logistic regression fitted
on labelled rows and on rows made of them: toxic texts with their terms misspelled stay toxic, clean texts that quote
or report a term stay clean. Labels, language, source and id are never inputs of a score."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut, held, in_sample, one_text, release, sample_share, slices

#: At most about this many labelled rows fit the lexicon and the regression.
TRAIN_ROWS = 20_000
#: Automaton states and words' matches that a task keeps; beyond that they are built anew.
MAX_STATES, MAX_SEEN = 100_000, 100_000
#: Matches of longer words are found anew each time, so that kept ones stay small.
KEPT_LETTERS = 100
#: How likely a lexicon holds any term by chance.
CHANCE = 0.05
FOLDS = 5
WINDOW = 6
STEM_LENGTHS = range(4, 9)
_WORD = re.compile(r"\w+", re.UNICODE)
_QUOTE = re.compile('["“”„«»]')
#: Words that report what someone else said.
REPORTING = frozenset("said says say wrote writes called calls quoted quote saying dit disait écrit sagte sagt schrieb dijo dice escribió".split())


def edits(term: str) -> int:
    """Misspellings allowed in a term: one from five letters on, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """terms: word or, with a trailing *, word beginning -> weight. spelled: the words that are also matched misspelled, with weights for that if they have some of their own."""

    terms: dict[str, float]
    spelled: dict[str, float] | frozenset[str]
    words: list[str] = field(init=False)
    stems: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        self.words = sorted(self.spelled)
        self.near = self.spelled if isinstance(self.spelled, dict) else {t: self.terms[t] for t in self.spelled}
        self.stems = {t[:-1]: w for t, w in self.terms.items() if t.endswith("*")}
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room = [0]  # the most edits that any term below a node allows
        for word in self.words:
            node = 0
            self.room[0] = max(self.room[0], edits(word))
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], edits(word))
            self.term[node] = word
        self.seen: dict[str, tuple[str, int, float] | None] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.index: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.best: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of trie nodes reached with so many edits, closed under letters the word leaves out."""
        queue = list(reached.items())
        while queue:
            node, used = queue.pop()
            if used < reached.get(node, 99):
                reached[node] = used
            for child in self.children[node].values():
                if used < self.room[child] and used + 1 < reached.get(child, 99):
                    reached[child] = used + 1
                    queue.append((child, used + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(used, self.term[node]) for node, used in key if self.term[node] and used <= edits(self.term[node])]
            self.best.append(min(ends)[::-1] if ends else None)
        return self.index[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, used: int) -> None:
            if used <= self.room[node] and used < reached.get(node, 99):
                reached[node] = used

        for node, used in self.states[state]:
            reach(node, used + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, used + (letter != c))  # the letter, or another in its place
        to = self.moves[state][c] = self._state(reached) if reached else -1
        return to

    def fuzzy(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the edits; ties go to the smaller term."""
        if len(self.states) > MAX_STATES:
            self._begin()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = to if to is not None else self._move(state, c)
            if state < 0:
                return None
        return self.best[state]

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, weight) for a lower-case word."""
        if word in self.seen:
            return self.seen[word]
        found = (word, 0, self.terms[word]) if word in self.terms else None
        if found is None:
            stems = [(self.stems[word[:k]], word[:k] + "*") for k in STEM_LENGTHS if word[:k] in self.stems and len(word) > k]
            if stems:
                weight, term = max(stems)
                found = (term, 0, weight)
        if found is None and len(word) > 3 and (near := self.fuzzy(word)):
            found = (near[0], near[1], self.near[near[0]])
        if len(word) < KEPT_LETTERS:
            if len(self.seen) > MAX_SEEN:
                self.seen.clear()
            self.seen[word] = found
        return found


FEATURES = ("weight", "distinct", "density", "misspelled", "quoted", "near_quoted")


def _marks(text: str) -> tuple[list[int], list[tuple[bool, bool]]]:
    """Places of quotation marks, and whether each may open and may close: a plain mark opens before a word and closes after one; others open or close by form, in either of the languages' ways."""
    places, ways = [], []
    for m in _QUOTE.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        opens, closes = not before or before.isspace() or before in "([-", not after or not after.isalnum()
        if m[0] == '"':
            ways.append((opens and bool(after.strip()), closes and bool(before.strip())))
        else:
            ways.append((m[0] in "„“«" or opens, m[0] in "”»" or closes))
        places.append(m.start())
    return places, ways


def features(text: str, lexicon: Lexicon) -> list[float]:
    """What a score is made of; a text without hits gives zeros."""
    text = text.lower()
    found = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    hits = [(i, at, hit) for i, (at, w) in enumerate(found) if (hit := lexicon.match(w))]
    if not hits:
        return [0.0] * len(FEATURES)
    plain = misspelled = quoted = reported = 0.0
    distinct = set()
    places, ways = _marks(text)
    for i, at, (term, wrong, weight) in hits:
        around = found[max(0, i - WINDOW) : i + WINDOW + 1]
        k = bisect_left(places, at)
        enclosed = 0 < k < len(places) and places[k - 1] >= around[0][0] - 1 and places[k] <= around[-1][0] + len(around[-1][1]) and ways[k - 1][0] and ways[k][1]
        if enclosed:
            quoted += weight
        elif any(w in REPORTING for _, w in around):
            reported += weight
        elif wrong:
            misspelled += weight
        else:
            plain += weight
            distinct.add(term if not term.endswith("*") else found[i][1])
    return [float(np.log1p(plain)), float(np.log1p(len(distinct))), float(np.log1p(100 * plain / len(found))), float(np.log1p(100 * misspelled / len(found))), float(np.log1p(quoted)), float(np.log1p(reported))]


def misspell(text: str, lexicon: Lexicon) -> str:
    """The text with a letter changed in each of its terms that may be misspelled."""

    def change(m: re.Match) -> str:
        word = m.group()
        hit = lexicon.match(word) if edits(word) else None
        if not hit or hit[1]:
            return word
        at = zlib.crc32(word.encode()) % len(word)
        return word[:at] + ("x" if word[at] != "x" else "q") + word[at + 1 :]

    return _WORD.sub(change, text.lower())


def quote(text: str, lexicon: Lexicon) -> str:
    """The text and a sentence that quotes or reports one or two terms."""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    terms = [lexicon.words[(seed >> s) % len(lexicon.words)] for s in (0, 9)][: 1 + seed % 2]
    return text + (f' They wrote "{" ".join(terms)}" there.' if seed & 2 else f" They said that {' '.join(terms)}.")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last; Newton steps with a ridge on all but the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def terms_of(text: str) -> set[str]:
    """Words of three letters or more, and their beginnings marked by *."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> pa.RecordBatch:
        rows = [(t, counts[1][t], counts[0][t]) for t in counts[0].keys() | counts[1].keys()]
        counts[0].clear()
        counts[1].clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["term", "toxic", "clean"])

    for batch in batches:
        for part in slices(batch, "text"):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counts[int(toxic > 0)].update(terms_of(text or ""))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    yield flush()


def _half(text: str) -> int:
    """Which half of the training rows a text is in: one weighs misspelled terms, the other teaches what such weights are worth."""
    return zlib.crc32(text.encode("utf-8", "replace")) & 1


def _count_near(terms: dict[str, float], spelled: dict[str, float], half: int):
    """Texts of a half, toxic and clean, that hold a misspelling of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms, spelled)
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    if _half(text or "") != half:
                        continue
                    hits = map(lexicon.match, set(_WORD.findall((text or "").lower())))
                    counts[int(toxic > 0)].update({hit[0] for hit in hits if hit and hit[1]})
        found = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([counts[k][t] for t in found], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    lexicon: dict[str, float]
    spelled: dict[str, float]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits lexicon and regression on labelled rows outside the held-out fold: all of them, or a seeded sample of about TRAIN_ROWS. An id counts once, by its least text.

    Without a toxic or without a clean row the model has no terms and scores everything 0."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = sample_share(usable.count(), TRAIN_ROWS)
    sample = F.broadcast(usable.where(in_sample(F.col("doc_id"), share, 9)))  # about TRAIN_ROWS rows of two integers
    rows = cut(one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(in_sample(F.col("doc_id"), share, 9)).join(sample, "doc_id"), "doc_id", "toxic"))
    sizes = {r.toxic > 0: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Model({}, {}, [0.0] * len(FEATURES) + [-10.0])
    counted = cut(rows.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0"))
    k, share = F.col("toxic") + F.col("clean"), n1 / (n1 + n0)
    lift = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    # The chance that rows without regard to labels hold a term so unevenly is at most exp(-k * divergence); with as many terms as were counted, none is to enter by it.
    gain = lambda n, p: F.when(n > 0, n * F.log(n / (k * p))).otherwise(0.0)
    evidence = gain(F.col("toxic"), share) + gain(F.col("clean"), 1 - share)
    chosen = counted.select("term", "toxic", "clean", lift.alias("lift"), evidence.alias("evidence")).where((F.col("lift") >= 2.0) & (F.col("evidence") >= float(np.log(max(counted.count(), 1) / CHANCE))))
    top = chosen.orderBy("term").collect()  # each needs several toxic rows of a bounded sample
    release(counted)
    counts = {r.term: r.toxic for r in top}
    weights_of = {r.term: min(4.0, float(r["lift"])) / 4.0 for r in top}
    # A beginning that says little more than one whole word gives way to it; a term that a beginning covers as strongly goes.
    words = [t for t in counts if not t.endswith("*")]
    covered = {w[:k] + "*" for w in words for k in STEM_LENGTHS if counts.get(w[:k] + "*", 0) * 0.9 <= counts[w]}
    lexicon = {t: w for t, w in weights_of.items() if t not in covered}
    lexicon = {t: w for t, w in lexicon.items() if not any(lexicon.get(t[:k] + "*", -1.0) >= w for k in STEM_LENGTHS if k < len(t.rstrip("*")))}
    # Every word can be misspelled, also one that a beginning covers.
    spelled = {t: weights_of[t] for t in words if edits(t)}
    near = rows.mapInArrow(_count_near(lexicon, spelled, 0), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    for r in near.collect() if spelled else []:
        lifted = np.log((r.toxic + 0.5) / (n1 / 2 + 1.0)) - np.log((r.clean + 0.5) / (n0 / 2 + 1.0))
        doubt = 1.64 * np.sqrt(1 / (r.toxic + 0.5) + 1 / (r.clean + 0.5))  # the lower end of what the counts allow
        spelled[r.term] = min(spelled[r.term], max(0.0, float(lifted - doubt)) / 4.0)
    fitted = rows.mapInArrow(_taught(lexicon, spelled), "toxic int, f array<double>").toPandas() if lexicon else None
    release(rows)
    if fitted is None or not len(fitted):
        return Model({}, {}, [0.0] * len(FEATURES) + [-10.0])
    weights = fit_logistic(np.array(fitted["f"].tolist()), (fitted["toxic"].to_numpy() > 0).astype(float))
    return Model(lexicon, spelled, weights.tolist())


def _lexicon(terms: dict[str, float], spelled: dict[str, float]) -> Lexicon:
    return held(("lexicon", hash((tuple(sorted(terms.items())), tuple(sorted(spelled.items()))))), lambda: Lexicon(terms, spelled))


def _taught(terms: dict[str, float], spelled: dict[str, float]):
    """Rows that teach the regression: each text, and a toxic one misspelled or a clean one that quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms, spelled)
        for batch in batches:
            for part in slices(batch, "text"):
                labels, rows = [], []
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    made = [text or ""]
                    if _half(made[0]) == 0:
                        continue
                    if lexicon.words:
                        made.append((misspell if toxic > 0 else quote)(made[0], lexicon))
                    rows += [features(x, lexicon) for x in made]
                    labels += [toxic] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "f"])

    return run


def _scores(model: Model, columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = _lexicon(model.lexicon, model.spelled), np.array(model.weights)
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t or "", lexicon) for t in part.column("text").to_pylist()]).reshape(len(part), len(FEATURES))
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), a row for every input row. Null and empty texts score as texts without hits; ids may be null or repeat; other columns are not read.

    Texts and words of any length count whole; of terms equally near to a word the smaller one counts; an empty table gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(model, ["doc_id"], schema), "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least `threshold`; columns as they are."""
    with_text = docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = _lexicon(model.lexicon, model.spelled), np.array(model.weights)
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t or "", lexicon) for t in part.column("text").to_pylist()]).reshape(len(part), len(FEATURES))
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("row")], names=["row"]).filter(pa.array(score < threshold))

    return with_text.mapInArrow(run, with_text.select("row").schema).select("row.*")
