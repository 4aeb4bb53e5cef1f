"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the page's visible text under byte-trigram models of known
languages, how often pages of a language declare what this page declares in its markup, and a prior of the page's host. Host priors
come from grouped sums of text posteriors, smoothed up the address: a host leans on its registered domain, that on its
suffix, that on the whole table. A page's own posterior is taken out of its host's sum, so text counts once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut, sample_share, slices

#: About this many documents of each language fit its text model, or all it has.
TRAIN_DOCS = 2_000
BUCKETS = 1 << 15
#: The share of a language's model that is common to all languages.
COMMON = 0.1
#: A text is never worth more than this many independent trigrams.
WORTH = 60
# Chosen here: labels below which registries of countries sell names, so that the registered domain has one label more.
SECOND_LEVEL = "ac co com edu gob gov go mil ne net nom or org"
#: Pages' worth of belief that a host, domain or suffix takes over from the level above.
LEAN = 5.0
# What never ends reaches to the end, so that each is a walk over the page whatever its markup.
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-case text whose white space is single."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    x = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    return ((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _counts(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        at = {name: i for i, name in enumerate(langs)}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text and lang in at:
                    sums.setdefault(at[lang], np.zeros(BUCKETS, np.int64))
                    sums[at[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in sums.items():
            k = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang, np.int32)), pa.array(k.astype(np.int32)), pa.array(own[k])], names=["lang", "bucket", "n"])

    return run


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """All languages and their log probabilities (bucket, language) from documents of known language, a seeded sample of each."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    langs = list(sizes)
    table = np.zeros((BUCKETS, max(1, len(langs))))
    if langs:
        shares = docs.sparkSession.createDataFrame([(x, sample_share(n, TRAIN_DOCS)) for x, n in sizes.items()], "lang string, share double")
        chosen = F.pmod(F.xxhash64(F.lit(31), F.col("doc_id")), F.lit(1_000_000)) < F.ceil(F.col("share") * 1_000_000)
        sample = known.join(F.broadcast(shares), "lang").where(chosen).select("text", "lang")  # a row for each language
        for r in sample.mapInArrow(_counts(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            table[r.bucket, r.lang] += r.n
    # Part of each model is what all languages have in common: trigrams that none has seen then tell nothing.
    pooled = (table.sum(axis=1, keepdims=True) + 0.5) / (table.sum() + 0.5 * BUCKETS)
    return langs, np.log((1 - COMMON) * table / np.maximum(table.sum(axis=0), 1) + COMMON * pooled)


def visible(html: str) -> str:
    """Text without markup; after the last > no tag can follow."""
    tags, last, tail = html.rpartition(">")
    return _DROP.sub(" ", tags + last) + tail


def declared(html: str, langs: list[str]) -> int:
    """Index of the declared language; one more for another, two more for none."""
    found = _DECLARED.search(html)
    if not found:
        return len(langs) + 1
    name = found[1].lower()
    return langs.index(name) if name in langs else len(langs)


def _evidence(langs: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch, "html"):
                html = [h or "" for h in part.column("html").to_pylist()]
                like = np.zeros((len(html), table.shape[1]))
                for i, h in enumerate(html):
                    found = trigrams(visible(h))
                    if len(found):
                        like[i] = table[found].mean(axis=0) * min(len(found), WORTH)
                like -= like.max(axis=1, keepdims=True)
                said = np.array([declared(h, langs) for h in html], np.int32)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(said), pa.array(like.tolist(), pa.list_(pa.float64()))], names=["page_id", "url", "said", "like"])

    return run


def _normal(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.transform(x, lambda v: v / total)


def _sums(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Element-wise sums of `mass` and the number of pages."""
    out = df.groupBy(*keys).agg(*[F.sum(F.col("mass")[i]).alias(f"m{i}") for i in range(n)], F.sum("pages").alias("pages"))
    return out.select(*keys, F.array(*[f"m{i}" for i in range(n)]).alias("mass"), "pages")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared), a row for every row of pages.

    Empty or null html gives an even text likelihood; a null address belongs to the host ''. Ties go to the more
    frequent language of the training documents. Repeated rows are pages of their own; ids may be null. Without any
    training language lang is null and confidence 0. Whole pages are read, in time that grows with their length. Other
    columns are not read."""
    langs, table = train(docs)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    if not langs:
        return source.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    n = len(langs)
    shared = source.sparkSession.sparkContext.broadcast(table)
    found = source.mapInArrow(_evidence(langs, shared), "page_id long, url string, said int, like array<double>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    found = found.withColumn("host", host).withColumn("mass", _normal(F.transform("like", F.exp)))
    found = cut(found.select("page_id", "said", "like", "host", "mass"))
    named = found.withColumn("pages", F.lit(1))

    # What pages of a language declare: n + 2 rows whatever the input.
    said = np.full((n + 2, n), 0.5)
    for r in _sums(named, n, "said").collect():
        said[r.said] += r.mass
    said = np.log(said / said.sum(axis=0))

    registered = rf"([^.]*\.((?:{SECOND_LEVEL.replace(' ', '|')})\.[a-z][a-z]|[^.]*))$"
    hosts = _sums(named, n, "host").withColumn("domain", F.regexp_extract("host", registered, 1)).withColumn("suffix", F.regexp_extract("host", registered, 2))
    domains = _sums(hosts, n, "suffix", "domain")
    suffixes = _sums(domains, n, "suffix")
    whole = _sums(suffixes.withColumn("all", F.lit(1)), n, "all").collect()
    total = np.array(whole[0].mass if whole else [0.0] * n) + 1.0
    top = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    lean = lambda mass, above: F.zip_with(mass, above, lambda m, a: m + F.lit(LEAN) * a)
    suffixes = suffixes.select("suffix", _normal(lean("mass", top)).alias("suffix_prior"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", _normal(lean("mass", F.col("suffix_prior"))).alias("domain_prior"))
    # Written first: a join with an aggregate of the same exchange can't split a hot host.
    priors = cut(hosts.join(domains, ["suffix", "domain"]).select("host", F.col("mass").alias("host_mass"), "domain_prior"))

    table_of_said = source.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(said)], "said int, said_logs array<double>")
    rows = found.join(priors, "host").join(F.broadcast(table_of_said), "said")  # n + 2 rows
    others = F.zip_with("host_mass", "mass", lambda h, own: F.greatest(h - own, F.lit(0.0)))
    prior = _normal(lean(others, F.col("domain_prior")))
    logs = F.zip_with(F.zip_with("like", prior, lambda a, p: a + F.log(p)), F.col("said_logs"), lambda a, b: a + b)
    posterior = _normal(F.transform("logs", lambda v: F.exp(v - F.col("top"))))
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs")).withColumn("posterior", posterior)
    names = F.array(*[F.lit(x) for x in langs])
    name = lambda x: F.element_at(names, F.array_position(F.col(x), F.array_max(x)).cast("int"))
    told = F.when(F.col("said") < n, F.element_at(names, F.least(F.col("said"), F.lit(n - 1)) + 1)).when(F.col("said") == n, F.lit("other"))
    return rows.select("page_id", name("posterior").alias("lang"), F.array_max("posterior").alias("confidence"), name("like").alias("text_lang"), told.alias("declared"))
