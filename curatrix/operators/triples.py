"""Triples (s, p, o, o_kind): generation, merging, deletion and node queries. A set of triples has no repeated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.session import cut, spread

COLUMNS = ["s", "p", "o", "o_kind"]
# The vocabulary.
TYPE, LABEL, SUBCLASS = "rdf:type", "rdfs:label", "rdfs:subClassOf"
ABSTRACT, PERSON, ORGANISATION, RESTRICTION = "ex:Abstract", "foaf:Person", "schema:Organization", "owl:Restriction"
AUTHOR, AUTHOR_OF, AFFILIATION, AFFILIATION_OF, CONTACT, CONTACT_FOR = "ex:hasAuthor", "ex:isAuthorOf", "ex:hasAffiliation", "ex:isAffiliationOf", "ex:contactPoint", "ex:isContactFor"


def triple(s: Column, p: str, o: Column, kind: str = "uri") -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))


def exploded(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def told(df: DataFrame, s: str, p: str, o: str | Column, kind: str = "uri") -> DataFrame:
    """A triple of each row. In a union of such tables a filter on p or o_kind leaves out what it rules out before anything is read."""
    return df.select(F.col(s).alias("s"), F.lit(p).alias("p"), (F.col(o) if isinstance(o, str) else o).alias("o"), F.lit(kind).alias("o_kind"))


def instance_triples(abstracts: DataFrame, authorship: DataFrame, affiliation: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """From abstracts (a, title), authorship (a, u), affiliation (u, f) and contacts (a, u): typed, labelled nodes and edges in both directions.

    Abstracts may repeat; authorship, affiliation and contacts are sets. Then no two parts share a triple, so each is made
    distinct by its own keys and nothing shuffles triples. The parts are read anew wherever the triples are used: give
    written tables."""
    named = affiliation.select("f").distinct()
    parts = [
        told(abstracts.select("a").distinct(), "a", TYPE, F.lit(ABSTRACT)), told(abstracts.select("a", "title").distinct(), "a", LABEL, "title", "literal"),
        told(authorship, "a", AUTHOR, "u"), told(authorship, "u", AUTHOR_OF, "a"), told(authorship.select("u").distinct(), "u", TYPE, F.lit(PERSON)),
        told(affiliation, "u", AFFILIATION, "f"), told(affiliation, "f", AFFILIATION_OF, "u"), told(named, "f", TYPE, F.lit(ORGANISATION)),
    ]
    if contacts is not None:
        parts += [told(contacts, "a", CONTACT, "u"), told(contacts, "u", CONTACT_FOR, "a")]
    return reduce(DataFrame.union, parts)


def restrictions(edges: DataFrame, prop: str) -> DataFrame:
    """Class axioms for edges (s, o): a some-values-from restriction whose node id is a hash of what it says, so that reruns agree."""
    node = F.concat(F.lit("_:"), F.substring(F.md5(F.concat_ws("|", "s", F.lit(prop), "o").cast("binary")), 1, 16))
    # A node says one edge, so distinct edges give distinct triples.
    with_node = edges.select("s", "o").distinct().select("s", "o", node.alias("b"))
    s, o, b = F.col("s"), F.col("o"), F.col("b")
    return exploded(with_node, triple(s, SUBCLASS, b, "bnode"), triple(b, TYPE, F.lit(RESTRICTION)), triple(b, "owl:onProperty", F.lit(prop)), triple(b, "owl:someValuesFrom", o))


def restricted(triples: DataFrame, rows: int = 0) -> DataFrame:
    """(b, s, o) of restrictions: the node, the class below it and what its property leads to, by one grouping of the triples, over as many tasks as some number of restrictions takes."""
    below, some = F.col("p") == SUBCLASS, F.col("p") == "owl:someValuesFrom"
    said = triples.where((below & (F.col("o_kind") == "bnode")) | some).select(F.when(below, F.col("o")).otherwise(F.col("s")).alias("b"), F.when(below, F.col("s")).alias("s"), F.when(some, F.col("o")).alias("o"))
    return spread(said, 2 * rows, "b").groupBy("b").agg(F.max("s").alias("s"), F.max("o").alias("o")).where("s is not null and o is not null")


# Object properties with their label, domain, range, inverse and the inverse's label; annotation properties; properties of citations as literals.
CITATION, SOURCE = "ex:Citation", "schema:sourceOrganization"
PROPERTIES = [
    (AUTHOR, "has author", ABSTRACT, PERSON, AUTHOR_OF, "is author of"),
    (CONTACT, "contact point", ABSTRACT, PERSON, CONTACT_FOR, "is contact for"),
    (AFFILIATION, "has affiliation", PERSON, ORGANISATION, AFFILIATION_OF, "is affiliation of"),
    (SOURCE, "source organization", ABSTRACT, ORGANISATION, "ex:isSourceOf", "is source of"),
]
CITED = [
    ("ex:hasCitation", "has citation", ABSTRACT, CITATION, "ex:isCitationOf", "is citation of"),
    ("ex:hasReference", "has reference", ABSTRACT, CITATION, "ex:isReferenceOf", "is reference of"),
]
CITED_LITERALS = [("ex:citation", "citation", ABSTRACT), ("ex:reference", "reference", ABSTRACT)]
ANNOTATIONS = "dct:title dct:abstract dct:subject dct:date dct:format dct:identifier dct:type dct:created dct:creator dct:description rdfs:label rdfs:comment owl:versionInfo dct:issued dct:language dct:publisher dcat:keyword dcat:theme".split()


def ontology(spark, citations_as_classes: bool = True) -> DataFrame:
    """Classes, properties in both directions and annotation properties."""
    rows = [(c, TYPE, "owl:Class", "uri") for c in (ABSTRACT, PERSON, ORGANISATION)]
    for prop, name, domain, range_, inverse, back in PROPERTIES + (CITED if citations_as_classes else []):
        for p, label, a, b in ((prop, name, domain, range_), (inverse, back, range_, domain)):
            rows += [(p, TYPE, "owl:ObjectProperty", "uri"), (p, LABEL, label, "literal"), (p, "rdfs:domain", a, "uri"), (p, "rdfs:range", b, "uri")]
        rows.append((prop, "owl:inverseOf", inverse, "uri"))
    for prop, label, domain in [("dct:relation", "relation", ABSTRACT)] + ([] if citations_as_classes else CITED_LITERALS):
        rows += [(prop, TYPE, "owl:DatatypeProperty", "uri"), (prop, LABEL, label, "literal"), (prop, "rdfs:domain", domain, "uri")]
    rows += [(p, TYPE, "owl:AnnotationProperty", "uri") for p in ANNOTATIONS]
    if citations_as_classes:
        rows.append((CITATION, TYPE, "owl:Class", "uri"))
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string")


def nodes_of(triples: DataFrame, kind: str) -> DataFrame:
    return triples.where((F.col("p").isin(TYPE, SUBCLASS)) & (F.col("o") == kind)).select("s").distinct()


def labels(triples: DataFrame) -> DataFrame:
    """(s, label): the smallest label, or the node's local name."""
    own = triples.groupBy("s").agg(F.min(F.when(F.col("p") == LABEL, F.col("o"))).alias("label"))
    return own.select("s", F.coalesce("label", F.regexp_extract("s", "([^/#:]*)$", 1)).alias("label"))


def titles(triples: DataFrame) -> DataFrame:
    """(s, title) of the nodes that have one: the title, else the smallest label."""
    own = triples.where(F.col("p").isin("dct:title", LABEL)).groupBy("s").agg(F.min(F.struct((F.col("p") != "dct:title").alias("second"), "o")).alias("best"))
    return own.select("s", F.col("best.o").alias("title"))


def _followed(merges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(old, new, least) followed until new is no old any more, and the rows that never end because they lead into a cycle; there least is the least address on the way.

    Each round doubles the reach, so a chain ends after the logarithm of its length; what is open once the reach exceeds
    the number of rows is in a cycle or leads into one."""
    table = merges.where("old <> new").groupBy("old").agg(F.min("new").alias("new")).withColumn("least", F.col("new"))
    reach, rows, table = 1, None, cut(table)
    while True:
        onward = table.select(F.col("old").alias("new"), F.col("new").alias("further"), F.col("least").alias("below"))
        endless = table.join(onward, "new")
        if endless.isEmpty():
            return table, None
        rows = rows or table.count()
        if reach > rows:
            return table, cut(endless.select("old", "new", "below"))
        met = table.join(onward, "new", "left")
        table = cut(met.select("old", F.coalesce("further", "new").alias("new"), F.least("least", F.coalesce("below", "least")).alias("least")))
        reach *= 2


def resolved(merges: DataFrame) -> DataFrame:
    """(old, new) followed to its end, so that chains of any length don't depend on their order. Of several targets of an address the least holds; the addresses of a cycle become its least one."""
    table, endless = _followed(merges)
    if endless is None:
        return table.select("old", "new")
    ends = endless.select("old", F.col("below").alias("end"))
    return table.join(ends, "old", "left").select("old", F.coalesce("end", "new").alias("new")).where("old <> new")


def cycles(merges: DataFrame) -> DataFrame:
    """(address, least) of the addresses whose merges lead back to themselves, with the least address of their cycle."""
    _, endless = _followed(merges)
    if endless is None:
        return merges.where(F.lit(False)).select(F.col("old").alias("address"), F.col("new").alias("least"))
    return endless.select(F.col("new").alias("address"), F.col("below").alias("least")).distinct()


def merge_uris(triples: DataFrame, merges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Triples with subjects and objects rewritten; addresses only, never literals. Only those that name an address which is
    merged, or merged into, can become equal to others, so only they are made distinct.

    names (new, label): organisations that are merged into; those that no triple knows as one get class, superclass and label."""
    by = cut(resolved(merges))
    ends = by.union(by.select("new", "new").distinct())
    subjects, objects = ends.toDF("s", "new_s"), ends.toDF("o", "new_o")
    met = triples.join(subjects, "s", "left").join(objects, "o", "left")
    address = ~F.col("o_kind").eqNullSafe("literal")
    o = F.when(address, F.coalesce("new_o", "o")).otherwise(F.col("o"))
    touched = F.col("new_s").isNotNull() | (F.col("new_o").isNotNull() & address)
    rewritten = met.where(touched).select(F.coalesce("new_s", "s").alias("s"), "p", o.alias("o"), "o_kind")
    rest = met.where(~touched).select(COLUMNS)
    if names is not None:
        known = triples.where((F.col("p") == SUBCLASS) & (F.col("o") == ORGANISATION)).select(F.col("s").alias("new"))
        fresh = names.join(by.select("new"), "new", "left_semi").join(known, "new", "left_anti")
        n = F.col("new")
        rewritten = rewritten.union(exploded(fresh, triple(n, TYPE, F.lit("owl:Class")), triple(n, SUBCLASS, F.lit(ORGANISATION)), triple(n, LABEL, F.col("label"), "literal")))
    return rest.union(rewritten.distinct())


def orphans(triples: DataFrame, doomed: DataFrame) -> DataFrame:
    """(node, kind): persons that only doomed abstracts (s) refer to, and organisations that then only such persons refer to."""
    refs = triples.where(F.col("p").isin(AUTHOR, CONTACT)).select("s", F.col("o").alias("node"))
    met = refs.join(doomed.select("s").distinct().withColumn("going", F.lit(True)), "s", "left")
    persons = cut(met.groupBy("node").agg(F.every(F.coalesce("going", F.lit(False))).alias("all")).where("all").select("node"))
    org_refs = triples.where(F.col("p") == AFFILIATION).select(F.col("s").alias("person"), F.col("o").alias("node"))
    going = persons.withColumnRenamed("node", "person")
    orgs = org_refs.join(going, "person", "left_semi").select("node").distinct().join(org_refs.join(going, "person", "left_anti").select("node").distinct(), "node", "left_anti")
    return persons.select("node", F.lit("person").alias("kind")).union(orgs.select("node", F.lit("organisation")))


def cascade_delete(triples: DataFrame, doomed: DataFrame) -> DataFrame:
    """Triples without doomed abstracts (s) and their orphans, as subject or as object address; a literal that reads like one stays."""
    doomed = cut(doomed.select("s").distinct())
    gone = cut(doomed.select(F.col("s").alias("node")).union(orphans(triples, doomed).select("node")).distinct())
    return without(triples, gone)


def without(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples that name none of the nodes (node) as subject or as object address. Literals aren't looked up."""
    left = triples.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").select(COLUMNS)
    literal = F.col("o_kind").eqNullSafe("literal")
    return left.where(literal).union(left.where(~literal).join(gone.withColumnRenamed("node", "o"), "o", "left_anti").select(COLUMNS))
