"""Registered queries over the driver's tables, each with SQL that gives the same rows.

Orders stand for abstracts, suppliers for authors, nations for affiliations; part names are the registry's canonicals.
Documents and labels stand for the stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions import documents, text
from curatrix.operators import curation, matching, profiles, records, search, triples
from curatrix.operators.graph import Graph
from curatrix.session import cut, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rows that a line of an order counts as where it is dealt: its names and places become several entries.
LINE_ROWS = 4


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Records

AUTHORS_SQL = """
    au AS (SELECT l_orderkey AS k, l_suppkey AS u, min(l_linenumber) * 10000000 + l_suppkey AS pos FROM lineitem GROUP BY 1, 2),
    named AS (SELECT k, u, pos, s_name AS name, n_name || ', ' || r_name AS aff FROM au JOIN supplier ON u = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, pos, u, name, aff): authors of abstracts in order, dealt by abstract. Lines meet their supplier first and are
    dealt once after it, with numbers in place of what a nation says; a task gets fewer lines than rows, as they grow into cells."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("u"), "l_linenumber")
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_name").alias("name"), "s_nationkey")
    met = spread(line.join(people, "u"), LINE_ROWS * line.count(), "k")
    au = met.groupBy("k", "u", "name", "s_nationkey").agg((F.min("l_linenumber") * F.lit(10_000_000) + F.col("u")).alias("pos"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    placed = au.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select("k", "u", "pos", "name", F.concat("n_name", F.lit(", "), "r_name").alias("aff"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their authors in order; the contact is the last author."""
    one = F.struct("pos", records.author(F.col("name"), F.array("aff")).alias("author"))
    people = authorship(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(one)).alias("people"))
    orders = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).otherwise(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"))
    rows = orders.join(people, F.col("o_orderkey") == F.col("k"))
    authors = F.transform("people", lambda x: x["author"])
    return rows.select(F.concat(F.lit("abstract_"), "o_orderkey").alias("file_title"), title.alias("title"), F.element_at(authors, -1)["name"].alias("contact"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"), authors.alias("authors"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("keywords"), F.array(F.concat(F.lit("10.1000/"), F.col("o_custkey").cast("string"))).alias("relations"))


@query(f"""WITH {AUTHORS_SQL},
    firsts AS (SELECT k, aff, min(pos) AS p FROM named GROUP BY 1, 2),
    affs AS (SELECT k, string_agg(aff, ' | ' ORDER BY p) AS affiliations FROM firsts GROUP BY 1),
    last AS (SELECT k, arg_max(u, pos) AS cu, arg_max(name, pos) AS contact FROM named GROUP BY 1),
    shown AS (SELECT k, string_agg(name, ' | ' ORDER BY pos) AS authors, string_agg(name || ': ' || aff, ' | ' ORDER BY pos) AS details,
        string_agg(name || ' (' || split_part(aff, ',', 1) || ')', ' · ' ORDER BY CASE WHEN u = cu THEN 0 ELSE 1 END, pos) AS author_display, min(contact) AS contact
        FROM named JOIN last USING (k) GROUP BY 1)
    SELECT 'abstract_' || o_orderkey AS file_title, CASE WHEN o_orderpriority = '1-URGENT' THEN 'abstract_' || o_orderkey ELSE o_orderpriority || ' ' || o_orderstatus END AS title,
        contact, authors, affiliations, author_display, details AS author_details, strftime(o_orderdate, '%Y') AS year,
        CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority ELSE '' END AS keywords, '10.1000/' || o_custkey AS relations
    FROM orders JOIN shown ON k = o_orderkey JOIN affs USING (k)""")
def flatten_entries(spark, sf_dir):
    flat = records.flatten(nested(spark, sf_dir)).withColumns({c: F.array_join(c, " | ") for c in ("authors", "affiliations", "relations")})
    return flat.withColumn("author_details", F.array_join(F.transform("author_details", lambda a: F.concat(a["name"], F.lit(": "), F.array_join(a["affs"], "; "))), " | "))


@query(f"""WITH {AUTHORS_SQL}, firsts AS (SELECT k, aff, min(pos) AS p FROM named GROUP BY 1, 2)
    SELECT k, string_agg(aff, ' | ' ORDER BY p) AS affiliations, count(*)::BIGINT AS n FROM firsts GROUP BY 1""")
def distinct_affiliations_ordered(spark, sf_dir):
    first = authorship(spark, sf_dir).groupBy("k", "aff").agg(F.min("pos").alias("p"))
    return first.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "aff"))), lambda x: x["aff"]), " | ").alias("affiliations"), F.count("*").alias("n"))


@query(f"""WITH {AUTHORS_SQL}, last AS (SELECT k, arg_max(u, pos) AS cu FROM named GROUP BY 1)
    SELECT k, string_agg(name || ' (' || split_part(aff, ',', 1) || ')', ' · ' ORDER BY CASE WHEN u = cu THEN 0 ELSE 1 END, pos) AS author_display FROM named JOIN last USING (k) GROUP BY 1""")
def author_display_contact_first(spark, sf_dir):
    return nested(spark, sf_dir).select(F.regexp_extract("file_title", r"(\d+)$", 1).cast("long").alias("k"), records.author_display(F.col("authors"), F.col("contact")).alias("author_display"))


@query("SELECT doc_id, trim(split_part(text, ',', 1)) AS short FROM documents")
def short_institution(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.short_institution(F.col("text")).alias("short"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'file_' || o_orderkey ELSE o_orderstatus END AS title, left(strftime(o_orderdate, '%Y-%m-%d'), 4) AS year FROM orders")
def title_fallback_year(spark, sf_dir):
    title = F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("file_"), "o_orderkey")).alias("title"), F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 1, 4).alias("year"))


@query("""SELECT event_id, event_type AS title, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user ' || user_id END AS contact, '' AS keywords,
    CASE WHEN event_id % 2 = 0 THEN 'user ' || user_id || ':' ELSE 'user ' || user_id || ':' || event_type END AS authors, CASE WHEN event_id % 3 = 0 THEN '' ELSE '10.1/' || event_id || ';7' END AS relations FROM events""")
def schema_repair(spark, sf_dir):
    """Even rows give an author as a string, odd rows an author with a scalar affiliation; every third row has no contact."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    contact = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"contact": "'), name, F.lit('", "relations": ["10.1/'), F.col("event_id").cast("string"), F.lit('", 7], ')))
    person = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit('{"name": "'), name, F.lit('", "affiliations": "'), "event_type", F.lit('"}')))
    raw = F.concat(F.lit('{"title": "'), "event_type", F.lit('", '), contact, F.lit('"keywords": null, "authors": ['), person, F.lit("]}"))
    fixed = e.select("event_id", records.repaired(raw).alias("r")).select("event_id", "r.*")
    shown = F.transform("authors", lambda a: F.concat(a["name"], F.lit(":"), F.array_join(a["affiliations"], "+")))
    return fixed.select("event_id", "title", "contact", "keywords", F.array_join(shown, ";").alias("authors"), F.array_join("relations", ";").alias("relations"))


@query("SELECT d.doc_id, CASE WHEN quality IS NULL THEN lang WHEN quality = 0 THEN lang ELSE 'q' || quality END AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fill_if_empty_merge(spark, sf_dir):
    old = F.when(F.col("quality") > 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).when(F.col("quality") == 0, F.lit(" "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", records.fill_empty(old, F.col("lang")).alias("value"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN '[!]' WHEN toxic > 0 THEN '[' || toxic || '?]' ELSE '[ok]' END AS badge FROM labels")
def status_badge(spark, sf_dir):
    status = F.when(F.col("quality") == 0, "failed").otherwise("pending")
    return table(spark, sf_dir, "labels").select("doc_id", records.badge(status, F.col("toxic")).alias("badge"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'that')")
def substring_search_title(spark, sf_dir):
    return records.contains_search(table(spark, sf_dir, "documents"), "That ", "text", "source").select("doc_id")


@query("SELECT conv_id FROM (SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY 1) WHERE contains(lower(roles), 'user assistant user')")
def substring_search_author(spark, sf_dir):
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ").alias("roles")
    return records.contains_search(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles), "user assistant USER", "roles").select("conv_id")


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example.org')")
def substring_search_affiliation(spark, sf_dir):
    return records.contains_search(table(spark, sf_dir, "pages"), "Example.org", "url").select("page_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skip' ELSE 'process' END AS action FROM documents")
def dry_run_plan(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.when(F.col("done"), "skip").otherwise("process").alias("action"))


@query("SELECT doc_id, CASE WHEN length(text) > 38 THEN left(text, 38) || '…' ELSE text END AS label, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'))::BIGINT AS n FROM documents")
def label_truncate_escape(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(t, 38).alias("label"), F.length(text.html_escape(t)).cast("long").alias("n"))


@query("SELECT source AS aff, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def affiliation_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("aff")).agg(F.count("*").alias("n"))


@query("SELECT count(source)::BIGINT AS total, count(DISTINCT source)::BIGINT AS distinct_n FROM documents")
def total_vs_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("source").alias("total"), F.countDistinct("source").alias("distinct_n"))


# Matching


def _longest_sql(x: str, y: str) -> str:
    """The longest common run of two strings, the earliest in x: its length times 1000 and 999 less its place; 0 without one."""
    return f"coalesce(list_max(flatten([[CASE WHEN contains({y}, substr({x}, i, k)) THEN k * 1000 + 999 - i ELSE 0 END FOR k IN range(1, least(length({x}) - i + 1, length({y})) + 1)] FOR i IN range(1, length({x}) + 1)])), 0)"


# Ratcliff/Obershelp ratios of the lower-case strings (a, b) of a CTE `compared`: the longest common run, then what lies left and right of it.
RATIO_SQL = f"""met AS (SELECT a, b, a AS x, b AS y, {_longest_sql("a", "b")} AS m FROM compared UNION ALL
        SELECT a, b, x, y, {_longest_sql("x", "y")} FROM (SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + k)]) AS x, unnest([substr(y, 1, j - 1), substr(y, j + k)]) AS y
            FROM (SELECT *, m // 1000 AS k, 999 - m % 1000 AS i, strpos(y, substr(x, 999 - m % 1000, m // 1000)) AS j FROM met WHERE m > 0)) WHERE x <> '' AND y <> ''),
    ratios AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 1 ELSE 2 * sum(m // 1000) / (length(a) + length(b)) END::DOUBLE AS ratio FROM met GROUP BY 1, 2)"""

RAWS_SQL = """reg AS (SELECT DISTINCT p_name AS cand, p_name AS c, -1 AS o FROM part UNION ALL SELECT p_name || ' ' || lower(min(p_type)), p_name, 1 FROM part GROUP BY p_name),
    raws AS (SELECT DISTINCT p_name AS raw FROM part UNION SELECT DISTINCT substr(p_name, 2) FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part),
    pairs AS (SELECT raw, cand, c, o, 1 - levenshtein(lower(raw), lower(cand)) / greatest(length(raw), length(cand))::DOUBLE AS s FROM raws, reg)"""


def raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("raw")).union(part.select(F.expr("substr(p_name, 2)"))).union(part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")))).distinct()


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as canonicals, each with one variant: the name with its first type."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.concat("p_name", F.lit(" "), F.lower(F.min("p_type"))).alias("variant"))
    return matching.registry_long(names.withColumn("place", F.lit(1)), "p_name", "variant", "place")


def canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("candidate")).distinct()


@query(f"""WITH {RAWS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY s DESC, c, o) AS r FROM pairs)
    SELECT raw, CASE WHEN s >= 0.7 THEN c END AS canonical, round(s, 4) AS score, CASE WHEN s >= 0.95 THEN 'auto_existing' WHEN s < 0.7 THEN 'auto_new' ELSE 'pending' END AS decision FROM best WHERE r = 1""")
def registry_match_lev(spark, sf_dir):
    return matching.decided(matching.match(raws(spark, sf_dir), registry(spark, sf_dir), text.levenshtein_similarity))


@query(f"""WITH RECURSIVE {RAWS_SQL}, compared AS (SELECT DISTINCT lower(raw) AS a, lower(cand) AS b FROM pairs), {RATIO_SQL},
    best AS (SELECT raw, c, ratio AS s, row_number() OVER (PARTITION BY raw ORDER BY ratio DESC, c, o) AS r FROM pairs JOIN ratios ON a = lower(raw) AND b = lower(cand))
    SELECT raw, CASE WHEN s >= 0.7 THEN c END AS canonical, round(s, 4) AS score, CASE WHEN s >= 0.95 THEN 'auto_existing' WHEN s < 0.7 THEN 'auto_new' ELSE 'pending' END AS decision FROM best WHERE r = 1""")
def registry_match_ratio(spark, sf_dir):
    return matching.decided(matching.match(raws(spark, sf_dir), registry(spark, sf_dir)))


# Labels of organisations: the words of a part's name as components; each canonical's variant lacks the first letter of one.
LABELS_SQL = """reg AS (SELECT DISTINCT replace(p_name, ' ', ', ') AS c FROM part WHERE p_size % 2 = 0), var AS (SELECT v, max(c) AS c FROM (SELECT substr(c, 2) AS v, c FROM reg UNION ALL SELECT 'x' || c || ' and all that stands beside it', c FROM reg) GROUP BY 1),
    raws AS (SELECT DISTINCT replace(p_name, ' ', ', ') AS raw FROM part UNION SELECT v FROM var UNION SELECT DISTINCT replace(p_name, ' ', ', ') || 's' FROM part),
    names AS (SELECT raw FROM raws WHERE raw NOT IN (SELECT c FROM reg)),
    pairs AS (SELECT raw, c, 1 - levenshtein(lower(raw), lower(c)) / greatest(length(raw), length(c))::DOUBLE AS s,
        1 - levenshtein(lower(trim(split_part(raw, ',', 1))), lower(trim(split_part(c, ',', 1)))) / greatest(length(trim(split_part(raw, ',', 1))), length(trim(split_part(c, ',', 1))))::DOUBLE AS g FROM names, reg)"""
GUARD_SQL = """known AS (SELECT raw, pairs.c AS c, s FROM pairs JOIN var ON v = raw AND var.c = pairs.c WHERE s >= 0.72 AND g >= 0.72),
    ranked AS (SELECT raw, c, s, row_number() OVER (PARTITION BY raw ORDER BY s DESC, c) AS r FROM pairs WHERE g >= 0.72 AND raw NOT IN (SELECT raw FROM known)),
    merged AS (SELECT raw, c AS canonical, 'variant-exact' AS method, round(s, 4) AS score FROM known UNION ALL SELECT raw, c, 'fuzzy', round(s, 4) FROM ranked WHERE r = 1 AND s >= 0.72)"""


def labels_of_organisations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raws, registry) as LABELS_SQL makes them."""
    part = table(spark, sf_dir, "part").select("p_size", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("c"))
    reg = part.where("p_size % 2 = 0").select("c").distinct()
    variants = reg.select("c", F.explode(F.array(F.expr("substr(c, 2)"), F.concat(F.lit("x"), "c", F.lit(" and all that stands beside it")))).alias("v")).withColumn("place", F.lit(1))
    names = part.select(F.col("c").alias("raw")).union(variants.select("v")).union(part.select(F.concat("c", F.lit("s"))))
    return names, matching.registry_long(variants, "c", "v", "place")


@query(f"WITH {LABELS_SQL}, {GUARD_SQL} SELECT raw, canonical, method, score FROM merged")
def guarded_merge_lev(spark, sf_dir):
    return matching.guarded_merge(*labels_of_organisations(spark, sf_dir), text.levenshtein_similarity)


FIRST_SQL = "lower(trim(split_part({}, ',', 1)))"


@query(f"""WITH RECURSIVE {LABELS_SQL.replace("pairs AS", "by_edits AS")}, compared AS (SELECT lower(raw) AS a, lower(c) AS b FROM by_edits UNION SELECT {FIRST_SQL.format("raw")}, {FIRST_SQL.format("c")} FROM by_edits), {RATIO_SQL},
    pairs AS (SELECT raw, c, x.ratio AS s, y.ratio AS g FROM by_edits JOIN ratios x ON x.a = lower(raw) AND x.b = lower(c) JOIN ratios y ON y.a = {FIRST_SQL.format("raw")} AND y.b = {FIRST_SQL.format("c")}), {GUARD_SQL}
    SELECT raw, canonical, method, score FROM merged""")
def guarded_merge_ratio(spark, sf_dir):
    return matching.guarded_merge(*labels_of_organisations(spark, sf_dir))


@query(f"WITH {LABELS_SQL}, {GUARD_SQL} SELECT canonical, count(*)::BIGINT AS n, round(min(score), 4) AS lowest FROM merged GROUP BY 1")
def merge_report_dry_run(spark, sf_dir):
    return matching.guarded_merge(*labels_of_organisations(spark, sf_dir), text.levenshtein_similarity).groupBy("canonical").agg(F.count("*").alias("n"), F.min("score").alias("lowest"))


@query(f"""WITH {RAWS_SQL}, sc AS (SELECT raw, c, o, CASE WHEN lower(raw) = lower(cand) THEN 1.0 WHEN contains(lower(raw), lower(cand)) OR contains(lower(cand), lower(raw)) THEN 0.9 ELSE s END AS s FROM pairs),
    best AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY s DESC, c, o) AS r FROM sc) SELECT raw, c AS canonical, round(s, 4)::DOUBLE AS score FROM best WHERE r = 1 AND s >= 0.85""")
def org_match_containment(spark, sf_dir):
    return matching.organisation_match(raws(spark, sf_dir), registry(spark, sf_dir), text.levenshtein_similarity)


@query("SELECT count(*)::BIGINT AS n, round(sum(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE), 3) AS total FROM (SELECT DISTINCT lower(p_name) AS a FROM part) x, (SELECT DISTINCT lower(p_name) AS b FROM part) y WHERE a < b")
def similarity_levenshtein(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("a")).distinct()
    pairs = matching.facing(names, names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.sum(text.levenshtein_similarity(F.col("a"), F.col("b"))), 3).alias("total"))


@query(f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name AS n FROM part), compared AS (SELECT DISTINCT lower(x.n) AS a, lower(y.n) AS b FROM names x, names y WHERE x.n <> y.n), {RATIO_SQL}
    SELECT x.n AS a, y.n AS b, round(ratio, 4) AS ratio FROM names x JOIN names y ON x.n <> y.n JOIN ratios r ON r.a = lower(x.n) AND r.b = lower(y.n)""")
def similarity_ratio(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return matching.facing(names, names.select(F.col("a").alias("b")), F.col("a") != F.col("b")).select("a", "b", F.round(text.ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


@query(f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name AS n FROM part), compared AS (SELECT DISTINCT lower(x.n) AS a, lower(y.n) AS b FROM names x, names y WHERE x.n < y.n), {RATIO_SQL},
    numbered AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM names),
    links AS (SELECT x.i, y.i AS j FROM numbered x JOIN numbered y ON x.i < y.i JOIN ratios r ON r.a = lower(x.n) AND r.b = lower(y.n) WHERE ratio >= 0.7),
    sides AS (SELECT j, list(i) AS before FROM links GROUP BY 1),
    swept AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders UNION ALL SELECT x.i, CASE WHEN list_has_any(leaders, coalesce(before, []::BIGINT[])) THEN leaders ELSE list_append(leaders, x.i) END FROM swept JOIN numbered x ON x.i = swept.i + 1 LEFT JOIN sides ON sides.j = x.i),
    heads AS (SELECT unnest(arg_max(leaders, i)) AS i FROM swept),
    taken AS (SELECT i AS j, i FROM heads UNION ALL SELECT j, min(links.i) FROM links JOIN heads ON heads.i = links.i WHERE j NOT IN (SELECT i FROM heads) GROUP BY 1)
    SELECT x.n AS leader, y.n AS member FROM taken JOIN numbered x ON x.i = taken.i JOIN numbered y ON y.i = taken.j""")
def cluster_leader(spark, sf_dir):
    names = canonicals(spark, sf_dir).select(F.col("candidate").alias("name"), F.col("candidate").alias("ord"))
    return matching.leader_clusters(names, 0.70)


@query("SELECT p_brand AS cluster, arg_max(p_name, n * 1000000 - o) AS mode FROM (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY 1, 2) GROUP BY 1")
def cluster_mode(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("o"))
    return counts.groupBy(F.col("p_brand").alias("cluster")).agg(F.max_by("p_name", F.struct("n", -F.col("o"))).alias("mode"))


@query("SELECT p_brand AS cluster, sum(n)::BIGINT AS total, string_agg(p_name || ':' || n, ';' ORDER BY n DESC, o) AS variants FROM (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY 1, 2) GROUP BY 1")
def cluster_totals(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("o"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("d"), "o", "p_name", "n")))
    return counts.groupBy(F.col("p_brand").alias("cluster")).agg(F.sum("n").alias("total"), F.array_join(F.transform(ordered, lambda x: F.concat(x["p_name"], F.lit(":"), x["n"].cast("string"))), ";").alias("variants"))


@query("SELECT p_type, arg_max(p_name, p_size * 10000000 - p_partkey) AS first FROM part GROUP BY 1")
def first_wins_argmax(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.max_by("p_name", F.struct("p_size", -F.col("p_partkey"))).alias("first"))


VARIANT_SQL = "m AS (SELECT p_name AS variant, min(p_brand) AS canonical FROM part WHERE p_size > 25 GROUP BY 1)"


def _variants(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.where("p_size > 25").groupBy(F.col("p_name").alias("variant")).agg(F.min("p_brand").alias("canonical"))
    return part.join(known, F.col("p_name") == F.col("variant"), "left").select("p_partkey", "p_name", F.coalesce("canonical", "p_name").alias("value"))


@query(f"WITH {VARIANT_SQL} SELECT p_partkey, coalesce(canonical, p_name) AS value FROM part LEFT JOIN m ON p_name = variant")
def variant_replace(spark, sf_dir):
    return _variants(spark, sf_dir).select("p_partkey", "value")


@query(f"WITH {VARIANT_SQL} SELECT p_partkey, p_name AS before, canonical AS after FROM part JOIN m ON p_name = variant WHERE p_name <> canonical")
def variant_diff(spark, sf_dir):
    return _variants(spark, sf_dir).where(~F.col("p_name").eqNullSafe(F.col("value"))).select("p_partkey", F.col("p_name").alias("before"), F.col("value").alias("after"))


# Decisions and stores

DECISIONS_SQL = "d AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'new' WHEN toxic = 1 THEN 'pending' ELSE 'existing' END AS decision FROM labels)"


def _decisions(spark, sf_dir):
    decision = F.when(F.col("quality") == 0, "new").when(F.col("toxic") == 1, "pending").otherwise("existing")
    return table(spark, sf_dir, "labels").select("doc_id", decision.alias("decision"))


@query(f"WITH {DECISIONS_SQL} SELECT x.doc_id, CASE WHEN decision = 'existing' THEN 'canonical ' || source WHEN decision = 'new' THEN 'new ' || source ELSE source END AS value FROM documents x LEFT JOIN d ON x.doc_id = d.doc_id")
def apply_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("author"), F.col("source").alias("raw"))
    made = _decisions(spark, sf_dir).join(rows.withColumnRenamed("author", "doc_id"), "doc_id")
    last = made.select(F.col("doc_id").alias("author"), "raw", "decision", F.concat(F.lit("canonical "), "raw").alias("matched_canonical"), F.concat(F.lit("new "), "raw").alias("new_canonical"), F.lit(1).alias("ord"))
    earlier = last.withColumns({"decision": F.lit("pending"), "ord": F.lit(0)})
    return curation.apply_decisions(rows, last.union(earlier)).select(F.col("author").alias("doc_id"), "value")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def skip_existing_semi(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return curation.existing(table(spark, sf_dir, "documents").select("doc_id"), labels.where("quality = 1"), labels.where("quality = 0"), key="doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing_anti(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return curation.unseen(table(spark, sf_dir, "documents").select("doc_id"), labels.where("quality = 1"), labels.where("quality = 0"), key="doc_id")


@query("SELECT coalesce(min(doc_id), 0)::BIGINT AS first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def first_unprocessed(spark, sf_dir):
    return curation.unseen(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), key="doc_id").agg(F.coalesce(F.min("doc_id"), F.lit(0).cast("long")).alias("first"))


@query("SELECT d.doc_id, m.first FROM documents d JOIN (SELECT text, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1) m ON d.text = m.text WHERE n > 1")
def title_first_match_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return docs.join(firsts, "key").select("doc_id", "first")


@query("SELECT source AS canonical, lang AS variant FROM (SELECT DISTINCT source, lang FROM documents)")
def registry_upsert(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.col("source").alias("canonical"), F.col("lang").alias("variant"))
    return curation.registry_upsert(pairs.where("variant = 'en'").distinct(), pairs)


def _stores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("pending").alias("_status"))
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi").drop("_status"), labels


@query("SELECT doc_id, lang, 'approved' AS store FROM documents WHERE doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, lang, 'staged' FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def approve(spark, sf_dir):
    staged, approved, _ = _stores(spark, sf_dir)
    approved, staged = curation.approve(staged, approved, staged.where("doc_id % 3 = 0").select("doc_id"), "doc_id")
    return approved.select("doc_id", "lang", F.lit("approved").alias("store")).union(staged.select("doc_id", "lang", F.lit("staged")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr'")
def discard(spark, sf_dir):
    staged, _, _ = _stores(spark, sf_dir)
    return staged.join(staged.where("lang = 'fr'").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'edited' ELSE lang END AS lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def save_approved(spark, sf_dir):
    _, approved, labels = _stores(spark, sf_dir)
    return curation.save(approved, labels.where("quality = 0").select("doc_id", F.lit("edited").alias("lang")), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def delete_approved(spark, sf_dir):
    _, approved, labels = _stores(spark, sf_dir)
    return approved.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, 'q' || quality AS lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE 'q' || quality <> lang")
def edit_tracking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return curation.edited(docs, table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang")), "doc_id", "lang")


PLACED_SQL = f"""WITH {AUTHORS_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS place, 'abstract_' || k AS file_title FROM named),
    dec AS (SELECT *, CASE u % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'new' WHEN 2 THEN 'auto_new' ELSE 'pending' END AS decision FROM placed)"""


def _reviewed(spark, sf_dir):
    """(records, decisions, firsts): a decision for every author and affiliation, and the first author of every second record."""
    people = authorship(spark, sf_dir)
    decision = F.when(F.col("u") % 4 == 0, "existing").when(F.col("u") % 4 == 1, "new").when(F.col("u") % 4 == 2, "auto_new").otherwise("pending")
    made = people.select(F.concat(F.lit("abstract_"), "k").alias("file_title"), F.col("name").alias("author"), F.col("aff").alias("raw"), decision.alias("decision"), F.when(decision == "existing", F.concat(F.lit("Canon "), "aff")).alias("matched_canonical"), F.when(decision == "new", F.concat(F.lit("New "), "aff")).alias("new_canonical"), "pos")
    whole = nested(spark, sf_dir).select("file_title", "authors")
    firsts = whole.where("cast(substr(file_title, 10) as long) % 2 = 0").select("file_title", F.col("authors")[0]["name"].alias("author"), F.col("authors")[0]["affiliations"][0].alias("raw"), F.lit(0).alias("place"), F.lit(0).alias("at"))
    return whole, made.withColumn("ord", F.col("pos")).drop("pos"), firsts


def _shown(df, *more):
    people = F.array_join(F.transform("authors", lambda a: F.concat(a["name"], F.lit(": "), F.array_join(a["affiliations"], "; "))), " | ")
    return df.select("file_title", people.alias("authors"), *more)


def _with_decisions(rows, made):
    counts = made.groupBy("file_title").agg(F.array_join(F.sort_array(F.collect_list("author")), " | ").alias("decided"))
    return _shown(rows).join(counts, "file_title", "left")


@query(f"""{PLACED_SQL}, kept AS (SELECT * FROM placed WHERE k % 2 = 1 OR place > 0), shown AS (SELECT file_title, string_agg(name || ': ' || aff, ' | ' ORDER BY pos) AS authors, string_agg(name, ' | ' ORDER BY name) AS decided FROM kept GROUP BY 1)
    SELECT DISTINCT file_title, coalesce(authors, '') AS authors, decided FROM placed LEFT JOIN shown USING (file_title)""")
def remove_author_cascade(spark, sf_dir):
    rows, made, firsts = _reviewed(spark, sf_dir)
    return _with_decisions(*curation.remove_author(rows, made, firsts, "file_title"))


@query(f"""{PLACED_SQL}, r AS (SELECT *, CASE WHEN k % 2 = 0 AND place = 0 THEN 'Renamed' ELSE name END AS new FROM placed)
    SELECT file_title, string_agg(new || ': ' || aff, ' | ' ORDER BY pos) AS authors, string_agg(new, ' | ' ORDER BY new) AS decided FROM r GROUP BY 1""")
def rename_author_cascade(spark, sf_dir):
    rows, made, firsts = _reviewed(spark, sf_dir)
    return _with_decisions(*curation.rename_author(rows, made, firsts.withColumn("name", F.lit("Renamed")), "file_title"))


@query(f"""{PLACED_SQL}, r AS (SELECT *, k % 2 = 0 AND place = 0 AS gone FROM placed)
    SELECT file_title, string_agg(name || ': ' || CASE WHEN gone THEN '' ELSE aff END, ' | ' ORDER BY pos) AS authors, string_agg(name, ' | ' ORDER BY name) FILTER (NOT gone) AS decided FROM r GROUP BY 1""")
def remove_affiliation_cascade(spark, sf_dir):
    rows, made, firsts = _reviewed(spark, sf_dir)
    return _with_decisions(*curation.remove_affiliation(rows, made, firsts, "file_title"))


def _approved(spark, sf_dir):
    rows, made, _ = _reviewed(spark, sf_dir)
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("Canon "), "n_name").alias("canonical"), F.lit(None).cast("string").alias("variant"))
    number = F.expr("cast(substr(file_title, 10) as long)")
    return curation.approve_reviewed(rows.where(number % 2 == 0).withColumn("_status", F.lit("pending")), rows.where(number % 2 == 1), made, known, rows.where(number % 3 == 0).select("file_title"), "file_title")


@query(f"""{PLACED_SQL} SELECT file_title, string_agg(name || ': ' || CASE WHEN k % 6 = 0 AND decision = 'existing' THEN 'Canon ' || aff WHEN k % 6 = 0 AND decision = 'new' THEN 'New ' || aff ELSE aff END, ' | ' ORDER BY pos) AS authors,
    CASE WHEN k % 2 = 1 OR k % 3 = 0 THEN 'approved' ELSE 'staged' END AS store FROM dec GROUP BY k, file_title""")
def approve_reviewed(spark, sf_dir):
    approved, staged, _ = _approved(spark, sf_dir)
    return _shown(approved, F.lit("approved").alias("store")).union(_shown(staged, F.lit("staged").alias("store")))


@query(f"""{PLACED_SQL}, own AS (SELECT DISTINCT CASE decision WHEN 'existing' THEN 'Canon ' || aff WHEN 'new' THEN 'New ' || aff ELSE aff END AS canonical, CASE WHEN decision <> 'auto_new' THEN aff END AS variant FROM dec WHERE k % 6 = 0 AND decision <> 'pending')
    SELECT canonical, variant FROM own UNION ALL SELECT 'Canon ' || n_name, NULL FROM nation""")
def approve_registry(spark, sf_dir):
    return _approved(spark, sf_dir)[2]


@query("SELECT doc_id, CASE WHEN r = 1 AND quality = 0 THEN 'edited' ELSE lang END AS lang, r::BIGINT AS place FROM (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY d.doc_id ORDER BY c) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id, range(2) t(c))")
def save_first_of_key(spark, sf_dir):
    """Every row stands twice in the store: the first one of a key takes the edit."""
    labels = table(spark, sf_dir, "labels")
    store = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi").select("doc_id", "lang", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("place"))
    return curation.save(store, labels.where("quality = 0").select("doc_id", F.lit("edited").alias("lang")), "doc_id", "place")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) || ',added' AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <> 2 GROUP BY 1")
def array_edit(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return turns.select("conv_id", F.array_join(F.array_append(F.filter("r", lambda x, i: i != 1), F.lit("added")), ",").alias("roles"))


@query("SELECT event_id, event_type FROM events")
def append_checkpoint(spark, sf_dir):
    """Batches appended twice: rows are keyed, so a repeated batch changes nothing."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    first, again = events.where("event_id % 2 = 0"), events
    return first.unionByName(curation.unseen(again, first, key="event_id"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def keyed_load_keep_last(spark, sf_dir):
    return curation.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type")


@query("SELECT doc_id, 'Curatrix' AS dct_publisher, 'chemistry' AS dcat_theme, 'abstract' AS dct_type, 'en' AS dct_language, '2025-03-01' AS dct_issued FROM documents")
def batch_constants(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.lit(v).alias(k) for k, v in records.CONSTANTS.items()], F.lit("2025-03-01").alias("dct_issued"))


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def valid_records_only(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit('["no record"]')).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").select("event_id", F.schema_of_variant(F.try_parse_json(raw)).alias("kind"))
    return parsed.where(F.startswith("kind", F.lit("OBJECT"))).select("event_id")


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status FROM labels WHERE toxic = 0")
def staged_filter(spark, sf_dir):
    status = F.when(F.col("toxic") == 1, "done").when(F.col("quality") == 0, "failed").otherwise("pending")
    return table(spark, sf_dir, "labels").select("doc_id", status.alias("status")).where(F.col("status").isin("pending", "failed"))


@query("SELECT doc_id, quality AS _error FROM labels")
def drop_staging_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("_error"), F.lit("pending").alias("_status"), F.array().alias("_aff_decisions"))
    return rows.drop(*curation.STAGING)


@query("SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY 1, 2")
def run_counters(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM documents WHERE contains(lower(text), 'ing')")
def result_count(spark, sf_dir):
    return records.contains_search(table(spark, sf_dir, "documents"), "ing", "text").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), first_value(doc_id) OVER (PARTITION BY source ORDER BY doc_id)) AS next FROM documents")
def cyclic_next(spark, sf_dir):
    return curation.cyclic_next(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", F.col("source")).select("doc_id", "next")


@query("SELECT p_name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'a') ORDER BY p_name LIMIT 100")
def candidate_list_capped(spark, sf_dir):
    return records.contains_search(table(spark, sf_dir, "part").select("p_name").distinct(), "a", "p_name").orderBy("p_name").limit(100)


@query("SELECT n_name, string_agg(left(s_name, 25), ';' ORDER BY s_name) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS r FROM supplier) JOIN nation ON s_nationkey = n_nationkey WHERE r <= 3 GROUP BY 1")
def sample_three(spark, sf_dir):
    names = F.slice(F.sort_array(F.collect_list("s_name")), 1, 3)
    by = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(names.alias("names"))
    return by.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.array_join(F.transform("names", lambda x: F.substring(x, 1, 25)), ";").alias("sample"))


@query("SELECT s_name, s_nationkey FROM supplier")
def ordered_report(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_name", "s_nationkey").orderBy("s_name")


@query("SELECT s_suppkey FROM supplier ORDER BY md5('7|' || s_suppkey) LIMIT 1")
def random_seed_node(spark, sf_dir):
    return table(spark, sf_dir, "supplier").orderBy(F.md5(F.concat(F.lit("7|"), "s_suppkey").cast("binary"))).select("s_suppkey").limit(1)


@query("SELECT doc_id FROM documents WHERE lang <> 'de'")
def store_minus_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(docs.where("lang = 'de'").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::INTEGER FROM labels")
def column_union(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return left.unionByName(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), allowMissingColumns=True)


@query("SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 40)")
def unmatched_distinct(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_name").distinct().join(part.where("p_partkey < 40").select("p_name"), "p_name", "left_anti")


# Scalars

@query("SELECT DISTINCT 'http://example.org/ns#' || replace(replace(regexp_replace(trim(p_name || '. ' || p_type), '[^A-Za-z0-9\\s._-]', '', 'g'), '.', ''), ' ', '_') AS uri FROM part")
def name_to_uri(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.name_to_uri(F.concat("p_name", F.lit(". "), "p_type")).alias("uri")).distinct()


@query("""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'uri' WHEN page_id % 3 = 1 THEN 'literal' ELSE 'uri' END AS kind,
    CASE page_id % 3 WHEN 0 THEN 'https://doi.org/10.1/' || page_id WHEN 1 THEN 'https://doi.org/10.1234/' || page_id || ', p. 3' ELSE url END AS value FROM pages""")
def interpret_value(spark, sf_dir):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("doi:10.1/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("10.1234/"), F.col("page_id").cast("string"), F.lit(", p. 3"))).otherwise(F.col("url"))
    kind, value = text.interpreted(raw)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), value.alias("value"))


@query("SELECT doc_id, '10.1234/x' || doc_id || ' 10.99999/y(' || doc_id % 7 AS dois FROM documents")
def extract_dois(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    seeded = F.concat(F.lit("see 10.1234/x"), key, F.lit(" and 10.99999/y("), (F.col("doc_id") % 7).cast("string"), F.lit(") or 10.1234/x"), key, F.lit("; 10.12/no"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.dois(seeded), " ").alias("dois"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 2 THEN 'Street ' || c_custkey ELSE '' END AS address,
    CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name ELSE n_name || ', ' || r_name END AS location
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def parse_organization(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("c_custkey") % 3
    raw = F.when(kind == 0, F.col("c_name")).when(kind == 1, F.concat_ws(", ", "c_name", "n_name")).otherwise(F.concat_ws(", ", "c_name", F.concat(F.lit("Street "), F.col("c_custkey").cast("string")), "n_name", "r_name"))
    name, address, location = text.parsed_organisation(raw)
    return c.select("c_custkey", name.alias("name"), address.alias("address"), location.alias("location"))


@query("SELECT n_nationkey, s_name AS author, n_name || ';' || n_regionkey AS affiliations FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def split_authors_and(spark, sf_dir):
    """Names joined as a workbook has them, split again; every author gets all affiliations."""
    people = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    rows = people.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = F.concat(F.array_join(F.slice("names", 1, F.size("names") - 1), ", "), F.when(F.size("names") > 1, F.lit(" and ")).otherwise(F.lit("")), F.element_at("names", -1), F.lit(","))
    orgs = F.concat("n_name", F.lit("; "), F.col("n_regionkey").cast("string"), F.lit(";"))
    return rows.select("n_nationkey", F.explode(text.split_authors(joined)).alias("author"), F.array_join(text.split_values(orgs, ";"), ";").alias("affiliations"))


@query("SELECT doc_id, trim(x) AS part FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), '.')) AS x FROM documents) WHERE trim(x) <> ''")
def explode_multi_valued(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.split_values(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.")).alias("part"))


@query("SELECT doc_id, source || ';' || lang AS keywords, 2::BIGINT AS n FROM documents")
def split_keywords(spark, sf_dir):
    parts = text.split_values(F.concat("source", F.lit(" ; ;"), "lang", F.lit(";")), ";")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, ";").alias("keywords"), F.size(parts).cast("long").alias("n"))


@query("SELECT event_id, props AS carved FROM events")
def json_carve(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.carved_json(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).alias("carved"))


@query("SELECT DISTINCT replace(p_name || ' & (!''~*) ' || p_type, ' ', '%20').replace('&', '%26') AS enc FROM part")
def percent_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.percent_encode(F.concat("p_name", F.lit(" & (!'~*) "), "p_type")).alias("enc")).distinct()


@query("SELECT DISTINCT 'http://example.org/ns#' || replace(left(p_name || ' ' || p_type, 12), ' ', '_') AS uri, left(p_name || ' ' || p_type, 20) AS label FROM part WHERE right(left(p_name || ' ' || p_type, 12), 1) <> ' '")
def citation_uri(spark, sf_dir):
    whole = F.concat("p_name", F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").where(F.substring(whole, 12, 1) != " ").select(text.name_to_uri(F.substring(whole, 1, 12)).alias("uri"), F.substring(whole, 1, 20).alias("label")).distinct()


@query("SELECT doc_id, replace(source || '</script>', '</', '<\\/') AS payload FROM documents")
def payload_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.concat("source", F.lit("</script>")), F.lit("</"), F.lit("<\\/")).alias("payload"))


@query("SELECT doc_id, arg_min(line, length(line) * 1000000 + i) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i <= 30 AND regexp_matches(line, '[A-Z][a-z]+ [a-z]+') GROUP BY 1")
def shortest_candidate_line(spark, sf_dir):
    lines = F.filter(F.slice(F.split("text", "\n"), 1, 30), lambda x: F.regexp_like(x, F.lit("[A-Z][a-z]+ [a-z]+")))
    shortest = F.reduce(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("line"))), F.lit(None).cast("struct<n:int,i:int,line:string>"), lambda a, b: F.when(a.isNull() | (b["n"] < a["n"]), b).otherwise(a))
    return table(spark, sf_dir, "documents").select("doc_id", shortest["line"].alias("line")).where("line is not null")


# Search

@query("SELECT doc_id, n FROM (SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents) ORDER BY n DESC, doc_id LIMIT 30")
def search_topk_contains(spark, sf_dir):
    n = F.expr("(length(text) - length(replace(text, 'the', ''))) div 3").alias("n")
    return table(spark, sf_dir, "documents").select("doc_id", n).orderBy(F.desc("n"), "doc_id").limit(30)


@query(f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name AS n FROM part), compared AS (SELECT DISTINCT 'blue steel' AS a, lower(n) AS b FROM names), {RATIO_SQL}
    SELECT n AS candidate, round(greatest(ratio, contains(b, a)::INT), 4)::DOUBLE AS score FROM names JOIN ratios ON b = lower(n) WHERE greatest(ratio, contains(b, a)::INT) >= 0.3 ORDER BY greatest(ratio, contains(b, a)::INT) DESC, n LIMIT 30""")
def search_topk_ratio(spark, sf_dir):
    names = canonicals(spark, sf_dir)
    score = F.greatest(text.ratio(F.lit("blue steel"), F.col("candidate")), F.contains(F.lower("candidate"), F.lit("blue steel")).cast("double"))
    return names.withColumn("score", score).where("score >= 0.3").orderBy(F.desc("score"), "candidate").limit(30).select("candidate", F.round("score", 4).alias("score"))


@query("SELECT conv_id, max(CASE WHEN contains(lower(text), 'and') THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM conversations GROUP BY 1")
def max_score_per_abstract(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.contains(F.lower("text"), F.lit("and")).cast("double")).alias("score"))


@query("SELECT doc_id FROM documents WHERE doc_id = (SELECT min(page_id) FROM pages)")
def record_lookup(spark, sf_dir):
    first = table(spark, sf_dir, "pages").agg(F.min("page_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(first, "doc_id", "left_semi")


# Triples and graph

EDGES_SQL = """ua AS (SELECT DISTINCT 'a:' || l_orderkey AS a, 'u:' || l_suppkey AS u FROM lineitem),
    uf AS (SELECT DISTINCT 'u:' || s_suppkey AS u, 'f:' || s_nationkey AS f FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))"""


def authored(spark, sf_dir):
    """(k, u, least): distinct abstracts and authors by number; least marks the author whose address is an abstract's smallest."""
    line = table(spark, sf_dir, "lineitem")
    pairs = spread(line.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("u")), line.count(), "k").distinct()
    name = F.col("u").cast("string")
    return cut(pairs.withColumn("least", name == F.min(name).over(Window.partitionBy("k"))))


def _edges(spark, sf_dir, au):
    own = table(spark, sf_dir, "supplier").join(au.select(F.col("u").alias("s_suppkey")).distinct(), "s_suppkey", "left_semi")
    affiliation = own.select(F.concat(F.lit("u:"), "s_suppkey").alias("u"), F.concat(F.lit("f:"), "s_nationkey").alias("f")).distinct()
    return au.select(F.concat(F.lit("a:"), "k").alias("a"), F.concat(F.lit("u:"), "u").alias("u")), cut(affiliation)


def edges(spark, sf_dir):
    return _edges(spark, sf_dir, authored(spark, sf_dir))


TRIPLES_SQL = f"""{EDGES_SQL},
    ab AS (SELECT 'a:' || o_orderkey AS a, o_orderpriority AS title, c.u AS contact FROM orders LEFT JOIN (SELECT a, min(u) AS u FROM ua GROUP BY 1) c ON c.a = 'a:' || o_orderkey),
    t AS (SELECT a AS s, 'rdf:type' AS p, 'ex:Abstract' AS o, 'uri' AS o_kind FROM ab UNION SELECT a, 'rdfs:label', title, 'literal' FROM ab
        UNION SELECT a, 'ex:contactPoint', contact, 'uri' FROM ab WHERE contact IS NOT NULL UNION SELECT contact, 'ex:isContactFor', a, 'uri' FROM ab WHERE contact IS NOT NULL
        UNION SELECT a, 'ex:hasAuthor', u, 'uri' FROM ua UNION SELECT u, 'ex:isAuthorOf', a, 'uri' FROM ua UNION SELECT u, 'rdf:type', 'foaf:Person', 'uri' FROM ua
        UNION SELECT u, 'ex:hasAffiliation', f, 'uri' FROM uf UNION SELECT f, 'ex:isAffiliationOf', u, 'uri' FROM uf UNION SELECT f, 'rdf:type', 'schema:Organization', 'uri' FROM uf)"""


def derived(spark, sf_dir):
    """Triples of abstracts with a contact, the author of smallest address. They are projections of written edges: a query reads those that it asks for."""
    au = authored(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    contacts = au.where("least").join(orders.select(F.col("o_orderkey").alias("k")), "k", "left_semi").select(F.concat(F.lit("a:"), "k").alias("a"), F.concat(F.lit("u:"), "u").alias("u"))
    abstracts = orders.select(F.concat(F.lit("a:"), "o_orderkey").alias("a"), F.col("o_orderpriority").alias("title"))
    return triples.instance_triples(abstracts, *_edges(spark, sf_dir, au), contacts)


@query(f"WITH {TRIPLES_SQL} SELECT s, p, o, o_kind FROM t")
def record_to_triples(spark, sf_dir):
    return derived(spark, sf_dir)


@query(f"WITH {TRIPLES_SQL} SELECT count(*)::BIGINT AS n, count(*) FILTER (p = 'rdf:type' AND o = 'ex:Abstract')::BIGINT AS abstracts, count(*) FILTER (p = 'rdf:type' AND o = 'foaf:Person')::BIGINT AS persons, count(*) FILTER (p = 'rdf:type' AND o = 'schema:Organization')::BIGINT AS orgs FROM t")
def graph_totals(spark, sf_dir):
    of = lambda kind, name: F.count_if((F.col("p") == triples.TYPE) & (F.col("o") == kind)).alias(name)
    return derived(spark, sf_dir).agg(F.count("*").alias("n"), of(triples.ABSTRACT, "abstracts"), of(triples.PERSON, "persons"), of(triples.ORGANISATION, "orgs"))


@query("SELECT DISTINCT '_:' || left(md5(s || '|ex:hasAuthor|' || o), 16) AS b, s, o FROM (SELECT 'a:' || l_orderkey AS s, 'u:' || l_suppkey AS o FROM lineitem)")
def class_restrictions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.count()
    pairs = spread(line.select(F.concat(F.lit("a:"), "l_orderkey").alias("s"), F.concat(F.lit("u:"), "l_suppkey").alias("o")), rows, "s")
    return triples.restricted(triples.restrictions(pairs, triples.AUTHOR), rows)


_PROPERTIES_SQL = """pr(p, l, d, r, i, b) AS (VALUES ('ex:hasAuthor', 'has author', 'ex:Abstract', 'foaf:Person', 'ex:isAuthorOf', 'is author of'), ('ex:contactPoint', 'contact point', 'ex:Abstract', 'foaf:Person', 'ex:isContactFor', 'is contact for'),
    ('ex:hasAffiliation', 'has affiliation', 'foaf:Person', 'schema:Organization', 'ex:isAffiliationOf', 'is affiliation of'), ('schema:sourceOrganization', 'source organization', 'ex:Abstract', 'schema:Organization', 'ex:isSourceOf', 'is source of'),
    ('ex:hasCitation', 'has citation', 'ex:Abstract', 'ex:Citation', 'ex:isCitationOf', 'is citation of'), ('ex:hasReference', 'has reference', 'ex:Abstract', 'ex:Citation', 'ex:isReferenceOf', 'is reference of')),
    ways AS (SELECT p, l, d, r FROM pr UNION ALL SELECT i, b, r, d FROM pr)"""


@query(f"""WITH {_PROPERTIES_SQL} SELECT p AS s, 'rdf:type' AS p, 'owl:ObjectProperty' AS o, 'uri' AS o_kind FROM ways UNION ALL SELECT p, 'rdfs:label', l, 'literal' FROM ways UNION ALL SELECT p, 'rdfs:domain', d, 'uri' FROM ways
    UNION ALL SELECT p, 'rdfs:range', r, 'uri' FROM ways UNION ALL SELECT p, 'owl:inverseOf', i, 'uri' FROM pr
    UNION ALL SELECT c, 'rdf:type', 'owl:Class', 'uri' FROM (VALUES ('ex:Abstract'), ('foaf:Person'), ('schema:Organization'), ('ex:Citation')) x(c)
    UNION ALL SELECT 'dct:relation', * FROM (VALUES ('rdf:type', 'owl:DatatypeProperty', 'uri'), ('rdfs:label', 'relation', 'literal'), ('rdfs:domain', 'ex:Abstract', 'uri')) y(a, b, c)
    UNION ALL SELECT unnest(string_split('dct:title dct:abstract dct:subject dct:date dct:format dct:identifier dct:type dct:created dct:creator dct:description rdfs:label rdfs:comment owl:versionInfo dct:issued dct:language dct:publisher dcat:keyword dcat:theme', ' ')), 'rdf:type', 'owl:AnnotationProperty', 'uri'""")
def ontology_header(spark, sf_dir):
    return triples.ontology(spark)


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT s FROM t WHERE p = 'rdf:type' AND o = 'foaf:Person'")
def triple_nodes_by_type(spark, sf_dir):
    return triples.nodes_of(derived(spark, sf_dir), triples.PERSON)


@query(f"WITH {TRIPLES_SQL} SELECT s, coalesce(min(o) FILTER (p = 'rdfs:label'), split_part(s, ':', 2)) AS label FROM t GROUP BY 1")
def node_labels(spark, sf_dir):
    return triples.labels(derived(spark, sf_dir))


@query(f"WITH {TRIPLES_SQL} SELECT s, regexp_extract(p, '([^:]*)$', 1) AS key, left(o, 100) AS value FROM t WHERE o_kind = 'literal'")
def literal_attributes(spark, sf_dir):
    return derived(spark, sf_dir).where("o_kind = 'literal'").select("s", F.regexp_extract("p", "([^/#:]*)$", 1).alias("key"), F.substring("o", 1, 100).alias("value"))


@query(f"""WITH {TRIPLES_SQL}, m AS (SELECT 'f:' || x AS old, 'f:' || (x // 8 * 8) AS new FROM range(25) r(x) WHERE x % 8 <> 0)
    SELECT DISTINCT coalesce(ms.new, s) AS s, p, CASE WHEN o_kind = 'literal' THEN o ELSE coalesce(mo.new, o) END AS o, o_kind FROM t LEFT JOIN m ms ON ms.old = s LEFT JOIN m mo ON mo.old = o""")
def uri_merge(spark, sf_dir):
    """Each nation merges into the one before it in blocks of eight, so that chains have to be followed."""
    chain = spark.range(25).where("id % 8 <> 0").select(F.concat(F.lit("f:"), "id").alias("old"), F.concat(F.lit("f:"), F.col("id") - 1).alias("new"))
    return triples.merge_uris(derived(spark, sf_dir), chain)


ORPHAN_SQL = f"""{TRIPLES_SQL}, doomed AS (SELECT DISTINCT s FROM t WHERE p = 'ex:hasAuthor' AND o IN (SELECT s FROM t WHERE p = 'ex:hasAffiliation' AND o = 'f:0')),
    refs AS (SELECT s, o AS node FROM t WHERE p IN ('ex:hasAuthor', 'ex:contactPoint')),
    po AS (SELECT DISTINCT node FROM refs WHERE s IN (SELECT s FROM doomed) AND node NOT IN (SELECT node FROM refs WHERE s NOT IN (SELECT s FROM doomed))),
    oref AS (SELECT s, o AS node FROM t WHERE p = 'ex:hasAffiliation'),
    oo AS (SELECT DISTINCT node FROM oref WHERE s IN (SELECT node FROM po) AND node NOT IN (SELECT node FROM oref WHERE s NOT IN (SELECT node FROM po))),
    orphan AS (SELECT node, 'person' AS kind FROM po UNION ALL SELECT node, 'organisation' FROM oo)"""


def _doomed(t):
    """Abstracts that somebody of nation 0 wrote."""
    people = t.where((F.col("p") == triples.AFFILIATION) & (F.col("o") == "f:0")).select(F.col("s").alias("o"))
    return t.where(F.col("p") == triples.AUTHOR).join(people, "o", "left_semi").select("s").distinct()


@query(f"WITH {ORPHAN_SQL} SELECT node, kind FROM orphan")
def orphan_preview(spark, sf_dir):
    t = derived(spark, sf_dir)
    return triples.orphans(t, _doomed(t))


@query(f"""WITH {EDGES_SQL.replace(" AS (", " AS MATERIALIZED (")},
    con AS MATERIALIZED (SELECT a, min(u) AS u FROM ua GROUP BY 1), ab AS MATERIALIZED (SELECT 'a:' || o_orderkey AS a, o_orderpriority AS title, c.u AS contact FROM orders LEFT JOIN con c ON c.a = 'a:' || o_orderkey),
    doomed AS MATERIALIZED (SELECT DISTINCT a FROM ua SEMI JOIN (SELECT u FROM uf WHERE f = 'f:0') x USING (u)),
    kept_people AS MATERIALIZED (SELECT DISTINCT u FROM ua ANTI JOIN doomed USING (a)), people AS MATERIALIZED (SELECT DISTINCT u FROM ua SEMI JOIN doomed USING (a)),
    po AS MATERIALIZED (SELECT u FROM people ANTI JOIN kept_people USING (u)), kept_orgs AS MATERIALIZED (SELECT DISTINCT f FROM uf ANTI JOIN po USING (u)),
    oo AS MATERIALIZED (SELECT DISTINCT f FROM uf SEMI JOIN po USING (u) ANTI JOIN kept_orgs USING (f)),
    gone AS MATERIALIZED (SELECT a AS n FROM doomed UNION SELECT u FROM po UNION SELECT f FROM oo),
    t AS MATERIALIZED (SELECT a AS s, 'rdf:type' AS p, 'ex:Abstract' AS o, 'uri' AS o_kind FROM ab UNION ALL SELECT a, 'rdfs:label', title, 'literal' FROM ab
        UNION ALL SELECT a, 'ex:contactPoint', contact, 'uri' FROM ab WHERE contact IS NOT NULL UNION ALL SELECT contact, 'ex:isContactFor', a, 'uri' FROM ab WHERE contact IS NOT NULL
        UNION ALL SELECT a, 'ex:hasAuthor', u, 'uri' FROM ua UNION ALL SELECT u, 'ex:isAuthorOf', a, 'uri' FROM ua UNION ALL SELECT DISTINCT u, 'rdf:type', 'foaf:Person', 'uri' FROM ua
        UNION ALL SELECT u, 'ex:hasAffiliation', f, 'uri' FROM uf UNION ALL SELECT f, 'ex:isAffiliationOf', u, 'uri' FROM uf UNION ALL SELECT DISTINCT f, 'rdf:type', 'schema:Organization', 'uri' FROM uf
        UNION ALL SELECT a || '/note', 'rdfs:label', a, 'literal' FROM ab)
    SELECT s, p, o, o_kind FROM t ANTI JOIN gone ON s = n LEFT JOIN gone g ON o = g.n WHERE g.n IS NULL OR o_kind = 'literal'""")
def cascade_delete(spark, sf_dir):
    """With a literal beside each abstract that reads like its address."""
    t = derived(spark, sf_dir)
    notes = triples.nodes_of(t, triples.ABSTRACT).select(F.concat("s", F.lit("/note")).alias("s"), F.lit(triples.LABEL).alias("p"), F.col("s").alias("o"), F.lit("literal").alias("o_kind"))
    return triples.cascade_delete(t.union(notes), _doomed(t))


@query(f"WITH {EDGES_SQL} SELECT u AS src, a AS dst FROM ua UNION SELECT u, f FROM uf")
def graph_edges(spark, sf_dir):
    return Graph(*edges(spark, sf_dir)).edges


@query("SELECT s_nationkey, count(DISTINCT s_suppkey)::BIGINT AS authors FROM supplier GROUP BY 1")
def node_degree(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("authors"))


@query("SELECT l_suppkey AS author, count(DISTINCT l_orderkey)::BIGINT AS abstracts, min(s_nationkey) AS affiliation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def node_detail_panels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_suppkey").alias("author")).agg(F.countDistinct("l_orderkey").alias("abstracts"), F.min("s_nationkey").alias("affiliation"))


def _visible_sql(focal: str, level: int) -> str:
    n = lambda column, of, table_, key: f"SELECT {column} AS id FROM {table_} WHERE {key} IN ({of})"
    start = f"SELECT '{focal}'"
    abs_, aff = (lambda of: n("a", of, "ua", "u")), (lambda of: n("f", of, "uf", "u"))
    au_a, au_f = (lambda of: n("u", of, "ua", "a")), (lambda of: n("u", of, "uf", "f"))
    if focal[0] == "u":
        co = au_a(abs_(start))
        parts = [f"{start} AS id UNION {abs_(start)} UNION {aff(start)}", co, au_f(aff(start)), aff(f"SELECT id FROM ({co}) WHERE id <> '{focal}'")]
    elif focal[0] == "a":
        parts = [f"{start} AS id UNION {au_a(start)} UNION {aff(au_a(start))}", abs_(au_a(start)), None, None]
    else:
        parts = [f"{start} AS id UNION {au_f(start)}", f"{abs_(au_f(start))} UNION {aff(au_f(start))}", None, None]
    ctes, last = [], ""
    for i in range(level):
        grown = parts[i] or (au_a if i == 2 else aff)(f"SELECT id FROM l{i}")
        ctes.append(f"l{i + 1} AS ({f'SELECT id FROM l{i} UNION ' if i else ''}{grown})")
        last = f"l{i + 1}"
    return f"WITH {EDGES_SQL}, {', '.join(ctes)} SELECT id FROM {last}"


def _add_visible(kind: str, focal: str) -> None:
    for level in (1, 2, 3, 4):
        query(_visible_sql(focal, level), f"visible_{kind}_L{level}")(lambda spark, sf_dir, level=level: Graph(*edges(spark, sf_dir)).visible(focal, level))


for _kind, _focal in (("author", "u:3"), ("abstract", "a:0"), ("affiliation", "f:14")):
    _add_visible(_kind, _focal)


@query(f"WITH {EDGES_SQL}, v AS (SELECT id FROM ({_visible_sql('u:3', 2)})) SELECT u AS src, a AS dst FROM ua WHERE u IN (SELECT id FROM v) AND a IN (SELECT id FROM v) UNION SELECT u, f FROM uf WHERE u IN (SELECT id FROM v) AND f IN (SELECT id FROM v)")
def induced_subgraph(spark, sf_dir):
    graph = Graph(*edges(spark, sf_dir))
    return graph.induced(graph.visible("u:3", 2))


def _subgraph(spark, sf_dir, focal, *steps):
    """Triples along given predicates, hop by hop from a node."""
    t = derived(spark, sf_dir)
    at, found = spark.range(1).select(F.lit(focal).alias("s")), None
    for predicates in steps:
        hop = t.where(F.col("p").isin(*predicates)).join(at, "s", "left_semi").select("s", "p", "o")
        found = hop if found is None else found.union(hop)
        at = hop.select(F.col("o").alias("s")).distinct()
    return found.distinct()


def _subgraph_sql(focal: str, *steps: tuple[str, ...]) -> str:
    at, parts = f"SELECT '{focal}'", []
    for predicates in steps:
        names = ", ".join(f"'{p}'" for p in predicates)
        parts.append(f"SELECT s, p, o FROM t WHERE p IN ({names}) AND s IN ({at})")
        at = f"SELECT o FROM ({parts[-1]})"
    return f"WITH {TRIPLES_SQL} " + " UNION ".join(parts)


for _name, _focal, _steps in (
    ("subgraph_person", "u:3", ((triples.AFFILIATION, triples.AUTHOR_OF, triples.CONTACT_FOR), (triples.AUTHOR,))),
    ("subgraph_abstract", "a:0", ((triples.AUTHOR, triples.CONTACT), (triples.AFFILIATION,))),
    ("subgraph_org", "f:14", ((triples.AFFILIATION_OF,), (triples.AUTHOR_OF,))),
):
    query(_subgraph_sql(_focal, *_steps), _name)(lambda spark, sf_dir, f=_focal, s=_steps: _subgraph(spark, sf_dir, f, *s))


@query("SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey)::BIGINT AS person FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def entity_ordinals(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return pairs.withColumn("person", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey")).cast("long"))


@query("SELECT o_orderkey, 'dct:' || k AS predicate, v AS value FROM (SELECT o_orderkey, 'status' AS k, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders) WHERE trim(v) <> ''")
def qname_predicates(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("stack(2, 'status', o_orderstatus, 'priority', o_orderpriority) as (k, value)"))
    return pairs.where(F.trim("value") != "").select("o_orderkey", F.concat(F.lit("dct:"), "k").alias("predicate"), "value")


@query(f"WITH {AUTHORS_SQL} SELECT k, string_agg(name || '=' || aff, ';' ORDER BY pos) AS raw FROM named GROUP BY 1")
def raw_affiliation_backup(spark, sf_dir):
    pairs = F.sort_array(F.collect_list(F.struct("pos", "name", "aff")))
    return authorship(spark, sf_dir).groupBy("k").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["name"], F.lit("="), x["aff"])), ";").alias("raw"))


@query("SELECT DISTINCT n_name || ', ' || r_name AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def canonical_set(spark, sf_dir):
    return nested(spark, sf_dir).select(F.explode("authors").alias("a")).select(F.explode("a.affiliations").alias("c")).select(F.trim("c").alias("canonical")).where("canonical <> ''").distinct()


# Profiles, decisions on demand, fuzzy search, documents


def _uri(x: str) -> str:
    return f"'http://example.org/ns#' || replace(replace(regexp_replace(trim({x}), '[^A-Za-z0-9\\s._-]', '', 'g'), '.', ''), ' ', '_')"


CELLS_SQL = f"""{AUTHORS_SQL},
    ab AS (SELECT 'a:' || o_orderkey AS a, o_orderpriority AS title, o_orderstatus AS status, 'https://doi.org/10.1234/' || o_orderkey AS rel, '10.1234/' || o_orderkey AS bare FROM orders WHERE o_orderkey IN (SELECT k FROM au)),
    ppl AS (SELECT DISTINCT 'a:' || k AS a, 'dct:contributor' AS p, name, {_uri("name")} AS node FROM named UNION SELECT 'a:' || k, 'dcat:contactPoint', arg_max(name, pos), {_uri("arg_max(name, pos)")} FROM named GROUP BY k),
    org AS (SELECT DISTINCT 'a:' || k AS a, split_part(aff, ', ', 1) AS short, split_part(aff, ', ', 2) AS place, replace(aff, ', ', ', Street 7, ') AS raw FROM named)"""


def cells(spark, sf_dir):
    """(k, a, column, value): orders as the rows of a workbook, one cell a row, dealt by k."""
    one = F.sort_array(F.collect_list(F.struct("pos", "name")))
    org = F.replace("aff", F.lit(", "), F.lit(", Street 7, "))
    by = authorship(spark, sf_dir).groupBy("k").agg(F.array_join(F.transform(one, lambda x: x["name"]), ", ").alias("names"), F.max_by("name", "pos").alias("contact"), F.array_join(F.collect_set(org), "; ").alias("orgs"))
    rows = table(spark, sf_dir, "orders").join(by, F.col("o_orderkey") == F.col("k"))
    stack = "stack(6, 'dct:title', o_orderpriority, 'FOAF:Agent', names, 'dcat:contactPoint', contact, 'schema:Organization', orgs, 'Further reading', concat('doi:10.1234/', k), 'odd:status', o_orderstatus) as (`column`, value)"
    return rows.select("k", F.concat(F.lit("a:"), "k").alias("a"), F.expr(stack))


@query(f"""WITH {CELLS_SQL}, o AS (SELECT a, short, place, raw, CASE WHEN short < 'J' THEN short ELSE raw END AS name, short < 'J' AS known FROM org),
    oo AS (SELECT *, {_uri("name")} AS node FROM o)
    SELECT 'ex:Abstracts' AS s, 'rdf:type' AS p, 'ex:ConferenceAbstractCollection' AS o, 'uri' AS o_kind
    UNION SELECT 'ex:Abstracts', 'ex:has_abstract', a, 'uri' FROM ab UNION SELECT a, 'rdf:type', 'ex:Abstract', 'uri' FROM ab
    UNION SELECT a, 'dct:title', title, 'literal' FROM ab UNION SELECT a, 'rdfs:label', title, 'literal' FROM ab
    UNION SELECT a, 'ex:status', status, 'literal' FROM ab UNION SELECT a, 'ex:Further_reading', rel, 'uri' FROM ab
    UNION SELECT a, p, node, 'uri' FROM ppl UNION SELECT node, 'rdf:type', 'foaf:Agent', 'uri' FROM ppl UNION SELECT node, 'rdfs:label', name, 'literal' FROM ppl
    UNION SELECT a, 'schema:Organization', node, 'uri' FROM oo UNION SELECT node, 'rdf:type', 'schema:Organization', 'uri' FROM oo UNION SELECT node, 'rdfs:label', name, 'literal' FROM oo
    UNION SELECT node, 'schema:address', node || '_address', 'uri' FROM oo WHERE known UNION SELECT node || '_address', 'rdf:type', 'schema:PostalAddress', 'uri' FROM oo WHERE known
    UNION SELECT node || '_address', 'schema:streetAddress', 'Street 7', 'literal' FROM oo WHERE known UNION SELECT node, 'schema:location', place, 'literal' FROM oo WHERE known""")
def flat_profile_triples(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = F.concat("n_name", F.lit(", Street 7, "), "r_name")
    known = places.where("n_name < 'J'").select(whole.alias("raw"), F.col("n_name").alias("name"), whole.alias("address"))
    return profiles.flat(cells(spark, sf_dir), known)


@query(f"""WITH {CELLS_SQL}, oo AS (SELECT *, {_uri("short")} AS node FROM org),
    links AS (SELECT 'ex:Abstracts' AS s, 'ex:has_abstract' AS p, a AS o, 'uri' AS k FROM ab UNION SELECT a, p, node, 'uri' FROM ppl UNION SELECT a, 'schema:Organization', node, 'uri' FROM oo
        UNION SELECT node, 'schema:address', node || '_address', 'uri' FROM oo UNION SELECT node || '_address', 'schema:streetAddress', 'Street 7', 'literal' FROM oo UNION SELECT node, 'schema:location', place, 'literal' FROM oo
        UNION SELECT a, 'dct:title', title, 'literal' FROM ab UNION SELECT a, 'ex:status', status, 'literal' FROM ab UNION SELECT a, 'ex:Further_reading', rel, 'uri' FROM ab),
    r AS (SELECT *, '_:' || left(md5(s || '|' || p || '|' || o), 16) AS b FROM links),
    kinds AS (SELECT p, min(k) AS k FROM links GROUP BY 1),
    c AS (SELECT a AS node, replace(a, ':', ' ') AS label, 'ex:Abstract' AS parent FROM ab UNION SELECT node, name, 'foaf:Agent' FROM ppl UNION SELECT node, short, 'schema:Organization' FROM oo
        UNION SELECT node || '_address', short || ' address', 'schema:PostalAddress' FROM oo UNION SELECT rel, 'doi:' || bare, NULL FROM ab)
    SELECT s, 'rdfs:subClassOf' AS p, b AS o, 'bnode' AS o_kind FROM r UNION SELECT b, 'rdf:type', 'owl:Restriction', 'uri' FROM r UNION SELECT b, 'owl:onProperty', p, 'uri' FROM r
    UNION SELECT b, CASE WHEN k = 'literal' THEN 'owl:hasValue' ELSE 'owl:someValuesFrom' END, o, k FROM r
    UNION SELECT p, 'rdf:type', CASE WHEN k = 'literal' THEN 'owl:DatatypeProperty' ELSE 'owl:ObjectProperty' END, 'uri' FROM kinds UNION SELECT p, 'rdfs:label', replace(split_part(p, ':', 2), '_', ' '), 'literal' FROM kinds
    UNION SELECT node, 'rdf:type', 'owl:Class', 'uri' FROM c UNION SELECT node, 'rdfs:label', label, 'literal' FROM c UNION SELECT node, 'rdfs:subClassOf', parent, 'uri' FROM c WHERE parent IS NOT NULL""")
def class_profile_triples(spark, sf_dir):
    return profiles.classes(cells(spark, sf_dir), "k")


@query(f"""WITH p AS (SELECT 'p:' || p_partkey AS a, p_name || ' ' || p_type AS c FROM part), n AS (SELECT *, {_uri("c")} AS node FROM p)
    SELECT a AS s, 'dct:relation' AS p, node AS o, 'uri' AS o_kind FROM n UNION SELECT node, 'rdf:type', 'ex:Citation', 'uri' FROM n UNION SELECT node, 'dct:bibliographicCitation', c, 'literal' FROM n
    UNION SELECT node, 'rdf:type', 'owl:Class', 'uri' FROM n UNION SELECT node, 'rdfs:subClassOf', 'ex:Citation', 'uri' FROM n UNION SELECT node, 'rdfs:label', c, 'literal' FROM n UNION SELECT a || '/plain', 'dct:relation', c, 'literal' FROM n""")
def citation_mode(spark, sf_dir):
    """Citations as classes, and as literals of a second set of abstracts."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("a"), F.concat("p_name", F.lit(" "), "p_type").alias("citation"))
    plain = rows.withColumn("a", F.concat("a", F.lit("/plain")))
    return profiles.citations(rows, True).union(profiles.citations(plain))


def _vowl_sql() -> str:
    fields = "id type iri label domain range parent inverse".split()
    item = "'{' || concat_ws(',', " + ", ".join(f"""'"{f}":"' || replace(replace({f}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'""" for f in fields) + ") || '}'"
    row = lambda *values: "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + ")"
    classes = [row("class", i, "owl:Class", i.replace("_", ":"), label, None, None, None, None) for i, label in profiles.BASE_CLASSES.values()]
    properties = [row("property", i, "owl:ObjectProperty", p, p.split(":")[1], d, r, None, inv) for p, (i, d, r, inv) in profiles.BASE_PROPERTIES.items()]
    parents = " ".join(f"WHEN '{p}' THEN '{v[0]}'" for p, v in profiles.BASE_PROPERTIES.items())
    return f"""WITH {TRIPLES_SQL}, named AS (SELECT s, coalesce(min(o) FILTER (p = 'rdfs:label'), split_part(s, ':', 2)) AS label FROM t GROUP BY 1),
    kinds AS (SELECT t.s AS iri, CASE o WHEN 'foaf:Person' THEN 'person' WHEN 'ex:Abstract' THEN 'abstract' ELSE 'organisation' END || row_number() OVER (PARTITION BY o ORDER BY t.s) AS id, label,
        CASE o WHEN 'foaf:Person' THEN 'foaf_Person' WHEN 'ex:Abstract' THEN 'ex_Abstract' ELSE 'schema_Organization' END AS parent FROM t JOIN named ON named.s = t.s WHERE p = 'rdf:type'),
    every(section, {", ".join(fields)}) AS (VALUES {", ".join(classes + properties)}
        UNION ALL SELECT 'class', id, 'owl:Class', iri, label, NULL, NULL, parent, NULL FROM kinds
        UNION ALL SELECT 'property', 'prop_' || (row_number() OVER (ORDER BY s, p, o) - 1), 'owl:ObjectProperty', p, split_part(p, ':', 2), x.id, y.id, CASE p {parents} END, NULL
            FROM t JOIN kinds x ON x.iri = s JOIN kinds y ON y.iri = o WHERE p IN ({", ".join(f"'{p}'" for p in profiles.BASE_PROPERTIES)}))
    SELECT section, id, {item} AS item FROM every"""


@query(_vowl_sql())
def vowl_document(spark, sf_dir):
    t = derived(spark, sf_dir)
    kind = F.when(F.col("o") == triples.PERSON, "person").when(F.col("o") == triples.ABSTRACT, "abstract").otherwise("organisation")
    nodes = t.where(F.col("p") == triples.TYPE).select(F.col("s").alias("id"), kind.alias("kind")).join(triples.labels(t).withColumnRenamed("s", "id"), "id")
    return profiles.drawing(nodes, t.where(F.col("p").isin(*profiles.BASE_PROPERTIES)))


@query(f"""WITH {RAWS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY s DESC, c, o) AS r FROM pairs)
    SELECT p_partkey AS author, raw, CASE WHEN p_size > 25 THEN p_brand WHEN s >= 0.7 THEN c END AS matched_canonical, CASE WHEN p_size > 25 THEN 1.0 ELSE round(s, 4) END::DOUBLE AS match_score,
        CASE WHEN p_size > 25 THEN 'existing' WHEN s >= 0.95 THEN 'auto_existing' WHEN s < 0.7 THEN 'auto_new' ELSE 'pending' END AS decision
    FROM part JOIN best ON raw = p_name || ' ' || lower(p_type) WHERE r = 1""")
def lazy_decisions(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("author"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("raw"), "p_size", "p_brand")
    made = pairs.where("p_size > 25").select("author", "raw", F.col("p_brand").alias("matched_canonical"), F.lit(1.0).alias("match_score"), F.lit("existing").alias("decision"))
    return curation.lazy_decisions(pairs, made, registry(spark, sf_dir), text.levenshtein_similarity)


@query("""WITH d AS (SELECT l.doc_id AS author, coalesce(source, 'none') AS raw, lang, CASE WHEN quality = 1 THEN 'auto_existing' WHEN toxic = 1 THEN 'pending' ELSE 'auto_new' END AS was FROM labels l JOIN documents x ON l.doc_id = x.doc_id)
    SELECT author, raw, CASE WHEN lang = 'en' THEN 'chosen' WHEN was = 'auto_existing' THEN 'canonical ' || raw END AS matched_canonical,
        CASE WHEN lang = 'en' THEN 'existing' WHEN lang = 'de' THEN 'new' WHEN lang = 'fr' THEN (CASE was WHEN 'auto_existing' THEN 'existing' WHEN 'auto_new' THEN 'new' ELSE 'pending' END) ELSE was END AS decision,
        CASE WHEN lang = 'de' THEN 'made' WHEN lang = 'fr' AND was = 'auto_new' THEN raw END AS new_canonical FROM d""")
def review_overrides(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.col("doc_id").alias("author"), F.coalesce("source", F.lit("none")).alias("raw"), "lang", F.when(F.col("quality") == 1, "auto_existing").when(F.col("toxic") == 1, "pending").otherwise("auto_new").alias("decision"))
    made = rows.select("author", "raw", F.when(F.col("decision") == "auto_existing", F.concat(F.lit("canonical "), "raw")).alias("matched_canonical"), "decision", F.lit(None).cast("string").alias("new_canonical"))
    choice = F.when(F.col("lang") == "en", "existing").when(F.col("lang") == "de", "new").when(F.col("lang") == "fr", "revert")
    overrides = rows.select("author", "raw", choice.alias("choice"), F.when(F.col("lang") == "en", "chosen").when(F.col("lang") == "de", "made").alias("name")).where("choice is not null")
    return curation.review(made, overrides)


def _near_sql(x: str) -> str:
    """The share of 'blue steal' that must change for it to lie in a text."""
    return f"list_min(flatten([[levenshtein('blue steal', substr(lower({x}), i, k)) FOR k IN range(0, 21)] FOR i IN range(1, length({x}) + 2)])) / 10.0"


@query(f"WITH near AS (SELECT p_partkey, least({_near_sql('p_name')}, {_near_sql('p_brand')}, {_near_sql('p_type')}) AS score FROM part) SELECT p_partkey, round(score, 4)::DOUBLE AS score FROM near WHERE score <= 0.35")
def fuzzy_search_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entries = part.select("p_partkey", F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array("p_type").alias("affiliations"))
    return search.fuzzy_search(entries, "blue steal").select("p_partkey", F.round("score", 4).alias("score")).orderBy("score", "p_partkey")


@query(f"WITH near AS (SELECT n, {_near_sql('n')}::DOUBLE AS score FROM (SELECT DISTINCT p_name AS n FROM part)) SELECT n AS id, n AS label, score FROM near WHERE score <= 0.35 ORDER BY score, n LIMIT 6")
def suggest_six(spark, sf_dir):
    return search.suggestions(canonicals(spark, sf_dir).select(F.col("candidate").alias("id"), F.col("candidate").alias("label")), "blue steal")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'that') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def search_contains_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.contains(F.lower("text"), F.lit("that")).cast("double").alias("score"))


@query(r"""WITH cleaned AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\v\x{85}\pZ]+|[\s\v\x{85}\pZ]+$', '', 'g') AS t FROM documents),
    numbered AS (SELECT doc_id, [regexp_replace(x, '^[\s\v\x{85}\pZ]+|[\s\v\x{85}\pZ]+$', '', 'g') FOR x IN string_split(t, chr(10))] AS lines FROM cleaned),
    titled AS (SELECT doc_id, lines, list_position([length(x) > 10 AND len(regexp_split_to_array(x, '[\s\v]+')) > 3 FOR x IN lines], true) AS title FROM numbered),
    blocks AS (SELECT doc_id, CASE WHEN title > 0 THEN [x FOR x IN list_slice(lines, title + 1, title + 5) IF x <> '' AND (regexp_matches(x, '\b[A-Z]\.?\s?[A-Z][a-z]+') OR regexp_matches(x, '\bUniversity\b|\bDortmund\b|\bInstitute\b|\bGermany\b') OR contains(x, ','))] ELSE [] END AS block FROM titled),
    rows AS (SELECT doc_id, unnest(block) AS line, generate_subscripts(block, 1) AS i FROM blocks),
    named AS (SELECT *, regexp_extract(line, '[A-Z][a-z]+(?:\s[A-Z]\.?)?\s[A-Z][a-z]+') AS name FROM rows),
    grouped AS (SELECT *, count(*) FILTER (name <> '') OVER (PARTITION BY doc_id ORDER BY i) AS author FROM named),
    authors AS (SELECT doc_id, author, max(name) || ': ' || coalesce(string_agg(line, '; ' ORDER BY i) FILTER (name = ''), '') AS said FROM grouped WHERE author > 0 GROUP BY 1, 2),
    lists AS (SELECT doc_id, string_agg(said, chr(10) ORDER BY author) AS said FROM authors GROUP BY 1)
    SELECT doc_id, array_to_string(block, chr(10)) AS block, coalesce(said, '') AS authors FROM blocks LEFT JOIN lists USING (doc_id)""")
def author_block(spark, sf_dir):
    """The block a line each, and an author a line with their affiliations."""
    blocks = table(spark, sf_dir, "documents").select("doc_id", documents.author_block(F.coalesce("text", F.lit(""))).alias("block"))
    said = F.transform(documents.attributed(F.col("block")), lambda x: F.concat(x["name"], F.lit(": "), F.array_join(x["affiliations"], "; ")))
    return blocks.select("doc_id", F.array_join("block", "\n").alias("block"), F.array_join(said, "\n").alias("authors"))


from curatrix.plans import lifecycle  # noqa: E402, F401  registers its queries
