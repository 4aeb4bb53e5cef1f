"""Every learned word is found misspelled."""

import random

from curatrix.llm import toxicity


def test_rare_words_and_words_of_a_stem_match_misspelled(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    common = [word(7) for _ in range(300)]
    rare = [word(8) for _ in range(30)] + ["zottigte", "zottigst", "zottigen"]
    toxic = [" ".join(rng.choices(common, k=40) + [rare[i % len(rare)], rare[(i * 7 + 1) % len(rare)]]) for i in range(330)]
    clean = [" ".join(rng.choices(common, k=40)) for _ in range(660)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame)
    lexicon = toxicity._lexicon(model.lexicon, model.spelled)
    assert "zottigte" not in model.lexicon  # its stem is kept
    for t in rare:
        found = lexicon.match("y" + t[1:])
        assert found and found[0] == t and found[1] == 1 and found[2] > 0.9, t
    texts = [(i, " ".join(rng.choices(common, k=40) + (["y" + t[1:]] if t else []))) for i, t in enumerate([*rare, None])]
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert all(scores[i] > scores[len(rare)] for i in range(len(rare)))


def test_states_are_built_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_STATES", 3)
    lexicon = toxicity.Lexicon({"disgusting": 1.0}, {"disgusting": 0.5})
    assert [lexicon.match(w) for w in ("dissgusting", "disgustin", "clean")] == [("disgusting", 1, 0.5), ("disgusting", 1, 0.5), None]
