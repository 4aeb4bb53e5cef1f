"""Queries on the life of a dataset: deletion in full, searches by mode, files, lists of a node's neighbours.

Orders stand for abstracts and for their records, suppliers for persons, nations for organisations; the title of an
abstract names its priority and every fiftieth customer, so that titles repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import curation, deletion, matching, search, triples
from curatrix.plans.catalogue import EDGES_SQL, RATIO_SQL, _edges, authored, query, table
from curatrix.session import cut, spread

_TITLE = "o_orderpriority || ' ' || (o_custkey % 50)"
_DATASET_SQL = f"""{EDGES_SQL}, ab AS (SELECT 'a:' || o_orderkey AS a, o_orderkey AS k, {_TITLE} AS title FROM orders),
    ref AS (SELECT a AS s, u AS node, 'person' AS kind FROM ua UNION SELECT a, f, 'organisation' FROM ua JOIN uf USING (u)),
    doomed AS (SELECT DISTINCT a AS s FROM ua JOIN uf USING (u) WHERE f IN ('f:0', 'f:7')),
    orphan AS (SELECT DISTINCT node, kind FROM ref WHERE s IN (SELECT s FROM doomed) AND node NOT IN (SELECT node FROM ref WHERE s NOT IN (SELECT s FROM doomed))),
    people AS (SELECT 'u:' || s_suppkey AS s, s_name AS name FROM supplier), places AS (SELECT 'f:' || n_nationkey AS s, n_name AS name FROM nation)"""


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples in which abstracts name persons and organisations, and all nodes have labels."""
    au = authored(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("a:"), "o_orderkey").alias("a"), F.expr(_TITLE).alias("title"))
    base = triples.instance_triples(orders, *_edges(spark, sf_dir, au))
    supplier = table(spark, sf_dir, "supplier")
    met = au.join(supplier.select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("f")), "u").select("k", "f")
    places = cut(spread(met, au.count(), "k").distinct()).select(F.concat(F.lit("a:"), "k").alias("a"), F.concat(F.lit("f:"), "f").alias("f"))
    people = supplier.select(F.concat(F.lit("u:"), "s_suppkey").alias("s"), F.col("s_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("f:"), "n_nationkey").alias("s"), F.col("n_name").alias("name"))
    named = [triples.told(x, "s", triples.LABEL, "name", "literal") for x in (people, nations)]
    return base.union(triples.told(places, "a", triples.SOURCE, "f")).union(named[0]).union(named[1])


def doomed(t: DataFrame) -> DataFrame:
    """Abstracts of two organisations."""
    return t.where((F.col("p") == triples.SOURCE) & F.col("o").isin("f:0", "f:7")).select("s").distinct()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two thirds of the orders; titles repeat, so one abstract may take another's record."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return orders.select(F.concat(F.lit("file"), "o_orderkey").alias("file_title"), F.expr(_TITLE).alias("dct:title"), F.col("o_orderkey").alias("ord"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select("o_orderkey")
    return keys.select(F.concat(F.lit("/pdf/file"), "o_orderkey", F.lit(".pdf")).alias("path"), F.concat(F.lit("file"), "o_orderkey").alias("file_title"))


def deleted(spark: SparkSession, sf_dir: str) -> deletion.Deleted:
    t = dataset(spark, sf_dir)
    return deletion.delete_abstracts(t, cut(deletion.counted(deletion.references(t))), records(spark, sf_dir), files(spark, sf_dir), doomed(t))


@query(f"WITH {_DATASET_SQL} SELECT node, kind, count(DISTINCT s)::BIGINT AS n FROM ref GROUP BY 1, 2")
def reference_counts(spark, sf_dir):
    return deletion.counted(deletion.references(dataset(spark, sf_dir)))


@query(f"WITH {_DATASET_SQL} SELECT node, kind, name AS label FROM orphan JOIN (SELECT * FROM people UNION ALL SELECT * FROM places) ON s = node")
def deletion_preview(spark, sf_dir):
    t = dataset(spark, sf_dir)
    return deletion.preview(t, deletion.counted(deletion.references(t)), cut(doomed(t)))


@query(f"WITH {_DATASET_SQL} SELECT node, kind, count(DISTINCT s)::BIGINT AS n FROM ref WHERE s NOT IN (SELECT s FROM doomed) GROUP BY 1, 2")
def deletion_counts(spark, sf_dir):
    """Counts kept by deltas; the SQL counts what is left anew."""
    return deleted(spark, sf_dir).counts


@query(f"""WITH {_DATASET_SQL}, gone AS (SELECT s AS n FROM doomed UNION SELECT node FROM orphan),
    t AS (SELECT a AS s, 'rdf:type' AS p, 'ex:Abstract' AS o FROM ab UNION SELECT a, 'rdfs:label', title FROM ab UNION SELECT a, 'ex:hasAuthor', u FROM ua UNION SELECT u, 'ex:isAuthorOf', a FROM ua UNION SELECT u, 'rdf:type', 'foaf:Person' FROM ua
        UNION SELECT u, 'ex:hasAffiliation', f FROM uf UNION SELECT f, 'ex:isAffiliationOf', u FROM uf UNION SELECT f, 'rdf:type', 'schema:Organization' FROM uf
        UNION SELECT s, 'schema:sourceOrganization', node FROM ref WHERE kind = 'organisation' UNION SELECT s, 'rdfs:label', name FROM people UNION SELECT s, 'rdfs:label', name FROM places)
    SELECT p, count(*)::BIGINT AS n, count(DISTINCT s)::BIGINT AS subjects, min(s || '|' || o) AS first, max(s || '|' || o) AS last FROM t ANTI JOIN gone ON s = n LEFT JOIN gone g ON o = g.n WHERE g.n IS NULL GROUP BY 1""")
def deletion_triples(spark, sf_dir):
    """What is left, by predicate."""
    both = F.concat("s", F.lit("|"), "o")
    return deleted(spark, sf_dir).triples.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.min(both).alias("first"), F.max(both).alias("last"))


_TAKEN_SQL = f"""{_DATASET_SQL}, asked AS (SELECT s, title, row_number() OVER (PARTITION BY title ORDER BY s) AS nth FROM doomed JOIN ab ON a = s),
    held AS (SELECT title, 'file' || k AS file_title, k, row_number() OVER (PARTITION BY title ORDER BY k) AS nth FROM ab WHERE k % 3 <> 0),
    taken AS (SELECT s, asked.title, file_title, k FROM asked LEFT JOIN held USING (title, nth))"""


@query(f"WITH {_TAKEN_SQL} SELECT 'file' || k AS file_title, title FROM ab WHERE k % 3 <> 0 AND k NOT IN (SELECT k FROM taken WHERE k IS NOT NULL)")
def deletion_records(spark, sf_dir):
    return deleted(spark, sf_dir).records.select("file_title", F.col("dct:title").alias("title"))


@query(f"WITH {_TAKEN_SQL} SELECT s, CASE WHEN k IS NULL THEN 'no record of that title' ELSE 'no such file' END AS warning, coalesce(file_title, title) AS what FROM taken WHERE k IS NULL OR k % 5 = 0")
def deletion_warnings(spark, sf_dir):
    return deleted(spark, sf_dir).warnings


@query(f"WITH {_TAKEN_SQL} SELECT s, file_title, '/pdf/' || file_title || '.pdf' AS path FROM taken WHERE k % 5 <> 0")
def deletion_files(spark, sf_dir):
    return deleted(spark, sf_dir).removed.where("path is not null").select("s", "file_title", "path")


@query(f"""WITH {_DATASET_SQL}, shown AS (SELECT title, min(a) AS s FROM ab GROUP BY 1)
    SELECT 'file' || k AS file_title, CASE WHEN k % 3 <> 0 THEN ab.title END AS title, CASE WHEN k % 3 <> 0 THEN shown.s END AS s, CASE WHEN k % 3 <> 0 THEN 'found' ELSE 'not in dataset' END AS state FROM ab JOIN shown USING (title) WHERE k % 5 <> 0""")
def file_to_node(spark, sf_dir):
    return deletion.nodes_of_files(files(spark, sf_dir), records(spark, sf_dir), dataset(spark, sf_dir))


_MODES = {"title": ("3-medium 4", "SELECT a AS s, title AS name FROM ab"), "author": ("suplier 12", "SELECT a AS s, name FROM ua JOIN people ON s = u"), "affiliation": ("nation_3", "SELECT ref.s, name FROM ref JOIN places ON node = places.s")}


def _add_mode(mode: str, asked: str, names: str) -> None:
    @query(f"""WITH RECURSIVE {_DATASET_SQL}, named AS ({names}), compared AS (SELECT DISTINCT '{asked}' AS a, lower(name) AS b FROM named), {RATIO_SQL},
        best AS (SELECT s, max(greatest(ratio, contains(b, ratios.a)::INT)) AS score FROM named JOIN ratios ON b = lower(name) GROUP BY 1)
        SELECT s, title, round(score, 4)::DOUBLE AS score FROM best JOIN ab ON a = s WHERE score >= 0.3 ORDER BY best.score DESC, s LIMIT 30""", f"triple_search_{mode}")
    def found(spark, sf_dir):
        return search.abstract_search(dataset(spark, sf_dir), asked, mode).withColumn("score", F.round("score", 4))


for _mode, (_asked, _names) in _MODES.items():
    _add_mode(_mode, _asked, _names)


@query(f"""WITH RECURSIVE {_DATASET_SQL}, texts AS (SELECT a AS s, title || '-T' AS t, title || '-T ' || title AS whole FROM ab), compared AS (SELECT DISTINCT '3-medium 4' AS a, lower(whole) AS b FROM texts), {RATIO_SQL}
    SELECT s, t AS name, round(ratio, 4)::DOUBLE AS score FROM texts JOIN ratios ON b = lower(whole) WHERE ratio >= 0.3 OR contains(b, a) ORDER BY ratio DESC, s LIMIT 10""")
def graph_search_abstract(spark, sf_dir):
    """Abstracts that have a title besides their label."""
    t = dataset(spark, sf_dir)
    titles = t.where((F.col("p") == triples.LABEL) & F.startswith("s", F.lit("a:"))).select("s", F.lit("dct:title").alias("p"), F.concat("o", F.lit("-T")).alias("o"), "o_kind")
    return search.graph_search(t.union(titles), "3-medium 4", triples.ABSTRACT, "dct:title").withColumn("score", F.round("score", 4))


_ORGANISATIONS_SQL = """org AS (SELECT lower(p_name) AS key, max(p_name) AS name, arg_max(p_brand, p_partkey) AS address FROM part GROUP BY 1),
    raws AS (SELECT DISTINCT p_name AS raw FROM part UNION SELECT DISTINCT substr(p_name, 2) FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part UNION SELECT 'x' || p_name || 'y' FROM part UNION SELECT 'nobody'),
    sc AS (SELECT raw, name, address, CASE WHEN lower(raw) = key THEN 1.0 WHEN contains(lower(raw), key) OR contains(key, lower(raw)) THEN 0.9 ELSE 1 - levenshtein(lower(raw), key) / greatest(length(raw), length(key))::DOUBLE END AS s FROM raws, org),
    best AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY s DESC, name) AS r FROM sc)"""


@query(f"WITH {_ORGANISATIONS_SQL} SELECT raw, s >= 0.85 AS matched, CASE WHEN s >= 0.85 THEN name ELSE raw END AS name, CASE WHEN s >= 0.85 THEN address END AS address, CASE WHEN s >= 0.85 THEN round(s, 4) ELSE 0 END::DOUBLE AS confidence FROM best WHERE r = 1")
def org_match_address(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.groupBy(F.lower("p_name").alias("key")).agg(F.max("p_name").alias("name"), F.max_by("p_brand", "p_partkey").alias("address"))
    p = F.col("p_name")
    raws = part.select(F.explode(F.array(p, F.expr("substr(p_name, 2)"), F.concat(p, F.lit(" "), F.lower("p_type")), F.concat(F.lit("x"), p, F.lit("y")), F.lit("nobody"))).alias("raw"))
    return matching.affiliated(raws, known, matching.text.levenshtein_similarity)


@query("""WITH c AS (SELECT o_orderkey AS k, 'file' || (o_orderkey + o_orderkey % 2 * 1000000000) AS file_title, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '  ' || upper(o_orderpriority || ' ' || o_custkey) || ' ' END AS title FROM orders),
    s AS (SELECT 'file' || o_orderkey AS file_title, o_orderpriority || ' ' || o_custkey AS title FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'none', '')
    SELECT k, CASE WHEN file_title IN (SELECT file_title FROM s) THEN 'file' WHEN title <> '' AND lower(trim(title)) IN (SELECT lower(title) FROM s) THEN 'title' END AS why FROM c
    WHERE file_title IN (SELECT file_title FROM s) OR (title <> '' AND lower(trim(title)) IN (SELECT lower(title) FROM s))""")
def duplicates_by_title(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    title = F.concat("o_orderpriority", F.lit(" "), F.col("o_custkey").cast("string"))
    new = orders.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("file"), F.col("o_orderkey") + F.col("o_orderkey") % 2 * 1000000000).alias("file_title"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("  "), F.upper(title), F.lit(" "))).alias("dct:title"))
    store = orders.where("o_orderkey % 7 = 0").select(F.concat(F.lit("file"), "o_orderkey").alias("file_title"), title.alias("dct:title"))
    return curation.duplicates(new, store, spark.range(1).select(F.lit("none").alias("file_title"), F.lit("").alias("dct:title"))).select("k", "why")


@query("""WITH au AS (SELECT DISTINCT l_suppkey AS u, l_orderkey AS k FROM lineitem), co AS (SELECT a.u, b.u AS v, count(*) AS n FROM au a JOIN au b ON a.k = b.k AND a.u <> b.u GROUP BY 1, 2),
    top AS (SELECT u, string_agg(s_name || ' (' || n || ')', ', ' ORDER BY n DESC, s_name) AS coauthors FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, s_name) AS r FROM co JOIN supplier ON v = s_suppkey) WHERE r <= 5 GROUP BY 1)
    SELECT 'u:' || s_suppkey AS id, s_name AS label, n_name AS affiliations, count(k)::BIGINT AS n_abstracts, string_agg('a:' || k, ' ' ORDER BY k) AS abstracts, coauthors FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN au ON au.u = s_suppkey LEFT JOIN top ON top.u = s_suppkey GROUP BY ALL""")
def author_panels(spark, sf_dir):
    """What a panel lists of an author: affiliations, abstracts in order, the five nearest co-authors."""
    au = authored(spark, sf_dir).select("u", "k")
    people = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    known = au.withColumnRenamed("u", "v").join(people.select(F.col("s_suppkey").alias("v")), "v", "left_semi")
    pairs = spread(au.join(known, "k").where("u <> v"), 4 * au.count(), "u").groupBy("u", "v").agg(F.count("*").alias("n"))
    # Names decide between equal counts only, so they are looked up for the five largest counts of an author and what equals the least of these.
    down = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("down"), "v"))).alias("met")
    most = pairs.groupBy("u").agg(down).select("u", F.explode(F.expr("filter(met, x -> x.down <= element_at(met, least(5, size(met))).down)")).alias("x"))
    met = most.select("u", "x.v", (-F.col("x.down")).alias("n")).join(people.select(F.col("s_suppkey").alias("v"), "s_name"), "v")
    five = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("down"), "s_name"))), 1, 5)
    near = met.groupBy("u").agg(F.array_join(F.transform(five, lambda x: F.concat(x["s_name"], F.lit(" ("), (-x["down"]).cast("string"), F.lit(")"))), ", ").alias("coauthors"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda k: F.concat(F.lit("a:"), k.cast("string"))), " ")
    own = au.groupBy("u").agg(F.count("*").alias("n_abstracts"), listed.alias("abstracts"))
    out = people.withColumnRenamed("s_suppkey", "u").join(own, "u").join(near, "u", "left")
    return out.select(F.concat(F.lit("u:"), "u").alias("id"), F.col("s_name").alias("label"), F.col("n_name").alias("affiliations"), "n_abstracts", "abstracts", "coauthors")
