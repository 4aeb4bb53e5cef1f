"""Deletions against one at a time in plain Python, and counts kept by deltas against a recount."""

import random

from curatrix.operators import deletion, search, triples


def world(seed):
    draw = random.Random(seed)
    t = set()
    for a in range(60):
        s = f"a:{a}"
        t |= {(s, "rdf:type", "ex:Abstract", "uri"), (s, "rdfs:label", f"T{a % 20}", "literal")}
        t |= {(s, "ex:hasAuthor", f"u:{draw.randrange(50)}", "uri") for _ in range(draw.randint(0, 3))}
        t |= {(s, "schema:sourceOrganization", f"f:{draw.randrange(25)}", "uri") for _ in range(draw.randint(0, 2))}
        if draw.random() < 0.5:
            t.add((s, "ex:contactPoint", f"u:{draw.randrange(50)}", "uri"))
        t.add((s, "dct:title", f"T{a % 20}", "literal"))
    t |= {(f"u:{u}", "rdfs:label", f"Person {u}", "literal") for u in range(40)} | {(f"u:{u}", "ex:hasAffiliation", f"f:{u % 25}", "uri") for u in range(50)}
    records = [(f"file{r}" if r % 9 else "", f"T{r % 22}" if r % 13 else None, r) for r in range(40)]
    return t, records, [(f"/x/file{r}.pdf", f"file{r}") for r in range(0, 40, 2)], draw.sample([f"a:{a}" for a in range(60)], 25)


def one_by_one(t, records, files, doomed):
    t, records, listed, removed, warnings, orphans = set(t), list(records), {f for _, f in files}, [], [], set()
    for a in sorted(doomed):
        title = next(o for s, p, o, _ in t if s == a and p == "dct:title")
        gone = {a}
        for preds in (("ex:hasAuthor", "ex:contactPoint"), ("schema:sourceOrganization",)):
            for node in {o for s, p, o, _ in t if s == a and p in preds}:
                if not any(p in preds and o == node and s != a for s, p, o, _ in t):
                    gone.add(node)
                    orphans.add(node)
        t = {x for x in t if x[0] not in gone and (x[2] not in gone or x[3] == "literal")}
        hit = next((r for r in records if (r[1] or "") == title), None)
        if hit is None:
            warnings.append((a, "no record of that title", title))
            continue
        records.remove(hit)
        removed.append((a, hit[0], hit[2], f"/x/{hit[0]}.pdf" if hit[0] in listed else None))
        if hit[0] and hit[0] not in listed:
            warnings.append((a, "no such file", hit[0]))
    return t, records, removed, warnings, orphans


def test_a_set_of_deletions_equals_one_at_a_time(spark):
    for seed in range(3):
        t, records, files, doomed = world(seed)
        frame = spark.createDataFrame(sorted(t), "s string, p string, o string, o_kind string")
        counts = deletion.counted(deletion.references(frame))
        got = deletion.delete_abstracts(frame, counts, spark.createDataFrame(records, "file_title string, `dct:title` string, ord long"), spark.createDataFrame(files, "path string, file_title string"), spark.createDataFrame([(a,) for a in doomed], "s string"))
        left, rest, removed, warnings, orphans = one_by_one(t, records, files, doomed)
        assert {tuple(r) for r in got.triples.collect()} == left
        assert sorted(map(tuple, got.records.collect()), key=repr) == sorted(rest, key=repr)
        assert sorted(map(tuple, got.removed.collect()), key=repr) == sorted(removed, key=repr)
        assert sorted(map(tuple, got.warnings.collect())) == sorted(warnings) and {w for _, w, _ in warnings} == {deletion.NO_RECORD, deletion.NO_FILE}
        assert {r.node for r in got.orphans.collect()} == orphans
        recount = deletion.counted(deletion.references(got.triples))
        assert {tuple(r) for r in got.counts.collect()} == {tuple(r) for r in recount.collect()}


def test_counts_follow_a_hundred_deletions_and_additions(spark):
    t, _, _, _ = world(7)
    refs = sorted({(s, o, "organisation" if p.startswith("schema") else "person") for s, p, o, _ in t if p in deletion.REFERENCES})
    frame = lambda rows: spark.createDataFrame(rows, "s string, node string, kind string")
    draw, held = random.Random(1), set(refs)
    counts = deletion.counted(frame(refs))
    for _ in range(4):
        gone = draw.sample(sorted(held), 25)
        added = [(f"b:{i}", draw.choice(refs)[1], "person") for i in draw.sample(range(1000), 10)]
        held = held - set(gone) | set(added)
        counts = triples.cut(deletion.changed(counts, frame(added), frame(gone)))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in deletion.counted(frame(sorted(held))).collect()}


def test_blank_searches_find_nothing(spark):
    frame = spark.createDataFrame(sorted(world(1)[0]), "s string, p string, o string, o_kind string")
    assert search.abstract_search(frame, " ", "title").collect() == []
    assert [r.s for r in search.abstract_search(frame, "person 3", "author", n=100, threshold=0.99).collect()]
