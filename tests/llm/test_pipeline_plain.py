"""Each stage of the pipeline against a plain version of it, on the whole small table and on odd rows."""

import re

import pytest
import sentencepiece as library
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import cotraining, mixing, sentencepiece, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_components(texts, k=5, percent=80):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    group = list(range(len(sets)))
    posting = {}
    for i, s in enumerate(sets):
        for x in s:
            posting.setdefault(x, []).append(i)
    for a, b in sorted({(v[0], b) for v in posting.values() for b in v[1:]} | {(a, b) for v in posting.values() for a in v for b in v if a < b}):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group] if x != y else group
    return group


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # 1 and 2: a stage keeps what its operator's scores say, row by row
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("score >= 0.5").collect()}
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert first.columns == corpus_pipeline.DOCUMENT and {r.doc_id for r in first.collect()} == rows.keys() - toxic
    poor = {r.doc_id for r in cotraining.score(docs, cotraining.train(docs, labels)).where("score < 0.5").collect()}
    second = corpus_pipeline.drop_poor(spark, docs, SF)
    assert {r.doc_id for r in second.collect()} == rows.keys() - poor
    # 3: one row of each group of a brute-force comparison, the one of the smallest id
    ids = sorted(rows)
    groups = {}
    for i, g in zip(ids, plain_components([rows[i].text for i in ids]), strict=True):
        groups.setdefault(g, []).append(i)
    third = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in third) == sorted(min(g) for g in groups.values())
    assert all(tuple(r) == tuple(rows[r.doc_id])[:5] for r in third)
    # 4: whole passes, and for the rest the words that stand in chosen blocks, one by one
    plan = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    made = {}
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        made.setdefault(r.doc_id, []).append(r)
    for i, p in plan.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", p.text or "")
        rest = [w for k, w in enumerate(words) if mixing.in_chosen(p.first + k, p.width, p.blocks, p.quota_blocks, p.phase)]
        want = sorted([words] * p.passes * bool(words) + [rest] * bool(rest))
        assert sorted(re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in made.get(i, [])) == want
        assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (p.lang, p.source) for r in made.get(i, []))
    # 5: the library's own ids
    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    few = docs.where("doc_id % 7 = 0")
    assert all(r.ids == model.encode(rows[r.doc_id].text) for r in corpus_pipeline.tokenize(spark, few, SF).collect())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \n", None, None, -1), (3, "word " * 30_000, "en", "a", 150_000), (3, "word " * 30_000, "en", "a", 150_000)]])
def test_odd_rows_pass_every_stage(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.DOCUMENT, name
        docs = spark.createDataFrame(docs.collect(), SCHEMA).withColumn("size", F.lit(1))
    got = corpus_pipeline.tokenize(spark, docs.drop("size"), str(tmp_path)).collect()
    assert all(r.round_trip for r in got)
