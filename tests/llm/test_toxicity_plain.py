"""Scores against a lexicon that compares every word with every term, words of any length, and terms that chance brings."""

import random

import numpy as np

from curatrix.llm import toxicity
from curatrix.llm.toxicity import Lexicon, edits, features

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Plain(Lexicon):
    """The same lexicon without trie and automata."""

    def fuzzy(self, word):
        near = [(d, t) for t in self.words if abs(len(t) - len(word)) <= edits(t) and (d := distance(word, t)) <= edits(t)]
        return min(near)[::-1] if near else None


def test_scores_equal_a_scorer_by_edit_distance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.Model({"idiot": 1.0, "scum": 0.8, "worthless": 0.9, "achlich*": 0.3}, {"idiot": 0.7, "worthless": 0.6, "mention": 0.2, "retional": 0.4}, [2.0, 1.5, 3.0, 5.0, -2.0, -2.0, -4.0])
    plain = Plain(model.lexicon, model.spelled)
    w = np.array(model.weights)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {i: 1 / (1 + np.exp(-np.clip(np.array(features(t or "", plain)) @ w[:-1] + w[-1], -30, 30))) for i, t in texts.items()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert len(plain.seen) > 1000 and any(hit and hit[1] for hit in plain.seen.values())


def test_words_of_any_length_are_learned_and_met_misspelled(spark):
    long = "abusive" * 9
    rows = [(i, f"word{i % 7} {long if i % 4 == 0 else 'kind'} other{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert long in model.spelled
    wrong = spark.createDataFrame([(1, f"a {long[:30]}x{long[31:]} b"), (2, "a kind b"), (3, "z" * 200_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(wrong, model).collect()}
    assert scores[1] > 0.5 > max(scores[2], scores[3])


def test_terms_by_chance_stay_out_and_rare_true_ones_enter(spark):
    """Of 1000 toxic rows 12 hold a term that no clean one has, 1.2 %; words at random come in three or so."""
    draw = random.Random(2)
    rows = [(i, " ".join(f"w{draw.randrange(4000)}" for _ in range(40)) + (" venomous" if i % 4 == 0 and i % 332 == 0 else "") + (" nasty" if i % 4 == 0 else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "nasty" in model.lexicon and not [t for t in model.lexicon if t.startswith("w")]
    assert any(t.startswith("venom") for t in model.lexicon)
