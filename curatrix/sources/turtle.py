"""Triples from and to Turtle files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import cut
from curatrix.sources import splitting

SCHEMA = "s string, p string, o string, o_kind string, o_lang string, o_dtype string"
# Addresses that the syntax itself implies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r'(?P<skip>\s+|#[^\n]*)|(?P<iri><[^>\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<kind>\^\^)'
    r"|(?P<at>@[A-Za-z][A-Za-z0-9-]*)|(?P<number>[+-]?\d+(?:\.\d+)?)(?=[\s;,.\]])|(?P<mark>[;,\[\]]|\.(?=\s|$))|(?P<name>[^\s;,\[\]\"<>^]*[^\s;,\[\]\"<>^.])",
    re.S,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _plain(raw: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, raw, flags=re.S)


class _Document:
    """Statements of a text; a blank node is named by a hash of what it says, so that reruns agree."""

    def __init__(self, source: str, prefixes: dict[str, str] | None = None):
        self.tokens, at = [], 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"no Turtle at character {at}: {source[at : at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.prefixes, self.rows = 0, dict(prefixes or {}), []

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def expanded(self, name: str) -> str:
        if name.startswith("_:"):
            return name
        prefix, _, local = name.partition(":")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, raw = self.next()
        if kind == "iri":
            return raw[1:-1], "uri", None, None
        if kind == "number":
            return raw, "literal", None, XSD + ("decimal" if "." in raw else "integer")
        if kind in ("text", "long"):
            value, lang, dtype = _plain(raw[3:-3] if kind == "long" else raw[1:-1]), None, None
            if self.peek().startswith("@"):
                lang = self.next()[1][1:]
            elif self.peek() == "^^":
                self.next()
                dtype = self.term()[0]
            return value, "literal", lang, dtype
        if raw == "[":
            start = len(self.rows)
            inner = self.properties(None)
            self.next()
            del self.rows[start:]
            node = "_:" + hashlib.md5(repr(sorted(inner, key=repr)).encode()).hexdigest()[:16]
            self.rows += [(node if s is None else s, *rest) for s, *rest in inner]
            return node, "bnode", None, None
        if raw in ("true", "false"):
            return raw, "literal", None, XSD + "boolean"
        return (RDF + "type", "uri", None, None) if raw == "a" else (self.expanded(raw), "bnode" if raw.startswith("_:") else "uri", None, None)

    def properties(self, subject: str | None) -> list[tuple]:
        start = len(self.rows)
        while self.peek() not in (".", "]", ""):
            predicate = self.term()[0]
            while True:
                found = self.term()
                self.rows.append((subject, predicate, *found))
                if self.peek() != ",":
                    break
                self.next()
            while self.peek() == ";":
                self.next()
        return self.rows[start:]

    def statements(self) -> list[tuple]:
        while self.at < len(self.tokens):
            if self.peek() == "@prefix":
                self.next()
                name, iri = self.next()[1], self.next()[1]
                self.prefixes[name.rstrip(":")] = iri[1:-1]
            else:
                self.properties(self.term()[0])
            if self.peek() == ".":
                self.next()
        return self.rows


def parsed(source: str, prefixes: dict[str, str] | None = None) -> list[tuple]:
    """(s, p, o, o_kind, o_lang, o_dtype) of a Turtle text."""
    return _Document(source, prefixes).statements()


#: What a line holds outside of long strings: addresses, strings that are whole, comments, or the start of a long string.
_OUTSIDE = re.compile(r'''<[^>\s]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|(?P<long>""")|"(?:[^"\\\n]|\\.)*"|(?P<note>#.*)''')
_CLOSES = re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""')
_PREFIX = re.compile(r"@prefix\s+([^\s:]*):\s*<([^>\s]*)>\s*\.")


def line_state(line: str, within: bool) -> tuple[bool, bool]:
    """(whether the next line is inside of a long string, whether a statement ends with this line) for a line that is inside of one itself or not."""
    at = 0
    if within:
        m = _CLOSES.match(line)
        if not m:
            return True, False
        at = m.end()
    last = ""
    while m := _OUTSIDE.search(line, at):
        last = (line[at : m.start()].rstrip() or last)[-1:] if m["note"] else "x"
        if m["long"]:
            return True, False
        at = m.end()
    rest = line[at:].rstrip()
    return False, (rest or last)[-1:] == "."


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to lines in the order of their blocks what they mean if the block starts outside (0) or inside (1) of a long string."""
    block, state = None, [False, True]
    for batch in batches:
        out: list[list[bool]] = [[], [], [], []]
        for at, line in zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True):
            if at != block:
                block, state = at, [False, True]
            for k in (0, 1):
                state[k], ends = line_state(line, state[k])
                out[k].append(state[k])
                out[2 + k].append(ends)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.bool_()) for c in out)], names=[*batch.schema.names, "in0", "in1", "ends0", "ends1"])


def _statements(prefixes: dict[str, str]):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for value in batch.column("value").to_pylist() for row in parsed(value, prefixes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=columns)

    return run


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The set of triples of one or more files, each read by as many tasks as it has splits.

    Lines are read in blocks. A first pass tells of each block how it ends, started outside or inside of a long string;
    the driver follows these, a row for each block, and with it a line's state and the number of its statement are
    known. Statements are parsed where their lines meet, with the prefixes of all files, which must not contradict."""
    kinds = "file string, block long, at long, value string, in0 boolean, in1 boolean, ends0 boolean, ends1 boolean"
    lines = cut(splitting.pieces(spark, path, "\n").mapInArrow(_states, kinds))
    ended = lines.groupBy("file", "block").agg(F.max_by(F.struct("in0", "in1"), "at").alias("last")).orderBy("file", "block").collect()
    starts, inside, file = [], False, None
    for r in ended:
        inside = inside and r.file == file
        starts.append((r.file, r.block, inside))
        file, inside = r.file, r["last"]["in1"] if inside else r["last"]["in0"]
    if not starts:
        return spark.createDataFrame([], SCHEMA)
    known = lines.join(F.broadcast(spark.createDataFrame(starts, "file string, block long, within boolean")), ["file", "block"])  # a row for each block
    known = known.withColumn("ends", F.when(F.col("within"), F.col("ends1")).otherwise(F.col("ends0")))
    numbered = splitting.running(known.select("file", "block", "at", "value", "ends"), F.col("ends").cast("int"), "number")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    statements = cut(numbered.groupBy("file", "number").agg(texts.alias("value")).select("value"))
    found = statements.where(F.contains("value", F.lit("@prefix"))).select(F.explode(F.regexp_extract_all("value", F.lit(r"@prefix\s+[^\s:]*:\s*<[^>\s]*>\s*\."), F.lit(0))).alias("text")).distinct()
    prefixes: dict[str, str] = {}
    for r in found.collect():  # declarations, of which a graph has a few
        name, iri = _PREFIX.match(r.text).groups()
        if prefixes.setdefault(name, iri) != iri:
            raise ValueError(f"prefix {name}: stands for {prefixes[name]} and {iri}")
    return statements.mapInArrow(_statements(prefixes), SCHEMA).distinct()


def turtle_lines(triples: DataFrame) -> DataFrame:
    """One statement a line with whole addresses: any part of the result is itself Turtle, and no subject, however many statements it has, meets in one task."""
    quoted = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(safe))
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), quoted, F.lit('"'), tail)).otherwise(node("o"))
    return triples.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), value, F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle_lines(triples.orderBy("s", "p", "o")).write.mode("overwrite").text(path)
