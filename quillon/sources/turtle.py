"""Turtle and N-Triples sources: triples of files, each a named graph.

Turtle is read a file at a time by one pass over its tokens with a stack of open nodes: prefixes and bases, `a`, `;` and `,`
lists, blank nodes with properties, collections, literals with languages and types, numbers with exponents, comments. Blank
nodes are named by their graph and their label or their place in the file, so that reading a file again gives the same names. N-Triples are
read line by line, so that one large file is split over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Collection, Iterator, Mapping
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship

TRIPLES = "s string, p string, o string, o_kind string, lang string, graph string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE, FIRST, REST, NIL = f"{RDF}type", f"{RDF}first", f"{RDF}rest", f"{RDF}nil"
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>(?:[^\W\d_][\w.-]*)?:[\w%-](?:[\w.%:-]*[\w%-])?|(?:[^\W\d_][\w-]*)?:|_:\w(?:[\w.-]*[\w-])?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _literal(token: str) -> str:
    body = token[3:-3] if token[:3] in ('"""', "'''") else token[1:-1]
    coded = lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1])
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", coded, body, flags=re.DOTALL)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood at {at}: {text[at : at + 30]!r}")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0]
        at = m.end()


class _Open:
    """A node whose properties are being read, or a collection (subject None) whose items are."""

    def __init__(self, kind: str, subject: tuple[str, str] | None = None):
        self.kind, self.subject, self.predicate, self.filled = kind, subject, None, False
        self.head: tuple[str, str] | None = None
        self.last: tuple[str, str] | None = None


def parse(text: str, graph: str = "", base: str = "") -> Iterator[tuple[str, str, str, str, str]]:
    """(subject, predicate, object, kind, language), kind one of iri, bnode and literal. Raises ValueError for what isn't Turtle."""
    tokens = list(_tokens(text))
    prefixes: dict[str, str] = {}
    space, made, i = hashlib.sha1(graph.encode()).hexdigest()[:12], 0, 0
    top = now = _Open("top")
    stack: list[_Open] = []

    def fresh() -> tuple[str, str]:
        nonlocal made
        made += 1
        return f"_:{space}-{made}", "bnode"

    def put(value: str, kind: str, lang: str = "") -> Iterator[tuple[str, str, str, str, str]]:
        if now.kind == "list":
            node = fresh()
            if now.last:
                yield now.last[0], REST, *node, ""
            now.head, now.last = now.head or node, node
            yield node[0], FIRST, value, kind, lang
        elif now.subject is None:
            if kind == "literal":
                raise ValueError(f"a literal has no properties: {value!r}")
            now.subject = value, kind
        elif now.predicate is None:
            if kind != "iri":
                raise ValueError(f"not a predicate: {value!r}")
            now.predicate = value
        elif now.filled:
            raise ValueError(f"unexpected {value!r}")
        else:
            now.filled = True
            yield now.subject[0], now.predicate, value, kind, lang

    while i < len(tokens):
        kind, value = tokens[i]
        i += 1
        following = tokens[i] if i < len(tokens) else ("end", "")
        if now is top and top.subject is None and (value in ("@prefix", "@base") or (kind == "word" and value.upper() in ("PREFIX", "BASE"))):
            named = value.lstrip("@").upper() == "PREFIX"
            part = tokens[i : i + 1 + named]
            if len(part) < 1 + named or part[-1][0] != "iri" or (named and not part[0][1].endswith(":")):
                raise ValueError(f"not a declaration after {value!r}")
            address = urljoin(base, part[-1][1][1:-1])
            base, prefixes = (base, {**prefixes, part[0][1][:-1]: address}) if named else (address, prefixes)
            i += 1 + named
            if value.startswith("@"):
                if i >= len(tokens) or tokens[i][1] != ".":
                    raise ValueError(f"no end of {value!r}")
                i += 1
        elif kind == "mark" and value in "[(":
            stack.append(now)
            now = _Open("node", fresh()) if value == "[" else _Open("list")
        elif kind == "mark" and value == "]" and now.kind == "node":
            if now.predicate is not None and not now.filled:
                raise ValueError("no object before ']'")
            done, now = now.subject, stack.pop()
            yield from put(*done)
        elif kind == "mark" and value == ")" and now.kind == "list":
            if now.last:
                yield now.last[0], REST, NIL, "iri", ""
            done, now = now.head or (NIL, "iri"), stack.pop()
            yield from put(*done)
        elif kind == "mark" and value in ",;" and now.kind != "list" and (now.filled or (value == ";" and now.predicate is None)):
            now.predicate, now.filled = (now.predicate if value == "," else None), False
        elif kind == "mark" and value == "." and now is top and top.subject is not None and (top.filled or top.predicate is None and (top.subject[1] == "bnode" or tokens[i - 2][1] == ";")):
            top = now = _Open("top")
        elif kind == "iri":
            yield from put(urljoin(base, value[1:-1]) if base else value[1:-1], "iri")
        elif kind == "word" and value == "a" and now.kind != "list" and now.subject is not None and now.predicate is None:
            yield from put(TYPE, "iri")
        elif kind == "word" and value in ("true", "false"):
            yield from put(value, "literal")
        elif kind == "name" and value.startswith("_:"):
            yield from put(f"_:{space}-n{value[2:]}", "bnode")
        elif kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix in {value!r}")
            yield from put(prefixes[prefix] + local, "iri")
        elif kind == "number":
            yield from put(value, "literal")
        elif kind in ("text", "long"):
            lang = following[1][1:] if following[0] == "lang" else ""
            if following[0] == "lang":
                i += 1
            elif following[0] == "type":
                if i + 1 >= len(tokens) or tokens[i + 1][0] not in ("iri", "name"):
                    raise ValueError("no type after '^^'")
                i += 2
            yield from put(_literal(value), "literal", lang)
        else:
            raise ValueError(f"unexpected {value!r}")
    if stack or top.subject is not None and not top.filled:
        raise ValueError("ends within a statement")


def parsed(files: DataFrame, graph: str = "graph", body: str = "text") -> DataFrame:
    """Triples of Turtle files (graph, text) with `error`: a file that isn't Turtle gives one row that says so, and no triples."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in TRIPLES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for g, b in zip(rows["g"], rows["b"], strict=True):
                try:
                    out = [(*t, g, None) for t in parse(b or "", g or "")]
                except ValueError as e:
                    out = [(None, None, None, None, None, g, str(e))]
                yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return files.select(F.col(graph).alias("g"), F.col(body).alias("b")).mapInPandas(run, f"{TRIPLES}, error string")


def triples(files: DataFrame, graph: str = "graph", body: str = "text") -> DataFrame:
    """Triples of Turtle files (graph, text), one named graph each; a file that isn't Turtle is an error."""
    rows = parsed(files, graph, body)
    fine = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "graph", "error")).cast("string")).otherwise(F.col("s"))
    return rows.select(fine.alias("s"), "p", "o", "o_kind", "lang", "graph")


def n_triples(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """Triples of N-Triples files, split by lines; blank lines and comments are left out, any other line that isn't a triple is an error."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    node, literal = r"<[^<>]*>|_:\S+", r"\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9-]+|\^\^<[^<>]*>)?"
    pattern = rf"^\s*({node})\s*(<[^<>]*>)\s*({node}|{literal})\s*\.\s*(?:#.*)?$"
    part = lambda n: F.regexp_extract("value", pattern, n)
    named = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(F.concat(F.lit(f"_:{hashlib.sha1(graph.encode()).hexdigest()[:12]}-n"), F.substring(c, F.lit(3), F.length(c))))
    o = part(3)
    said = F.regexp_extract(o, r"^\"((?:[^\"\\]|\\.)*)\"", 1)
    # escapes are rare: those of one character are undone by rule, a backslash last
    for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ('"', '"')):
        said = F.regexp_replace(said, rf"(?<!\\)((?:\\\\)*)\\{code}", f"$1{char}")
    said = F.replace(said, F.lit("\\\\"), F.lit("\\"))
    subject = F.when(part(1) == "", F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))).cast("string")).otherwise(named(part(1)))
    kind = F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")
    out = F.when(o.startswith('"'), said).otherwise(named(o))
    return rows.select(subject.alias("s"), named(part(2)).alias("p"), out.alias("o"), kind.alias("o_kind"), F.when(o.startswith('"'), F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)).otherwise("").alias("lang"), F.lit(graph).alias("graph"))


def ontology_files(spark: SparkSession, root: str, graphs: Mapping[str, tuple[str, str]], rules: Mapping[str, tuple[str, str]] | None = None, include_rules: bool = False, standards: Collection[str] | None = None) -> DataFrame:
    """(key, path, graph, text) of ontologies below a folder, given as key: (path, graph).

    Rule files, given by standard, are read only if asked for, of the named standards or all. Standards without rules and missing files
    are errors, found before anything is read.
    """
    wanted = dict(graphs)
    if include_rules:
        known = {k.lower(): v for k, v in (rules or {}).items()}
        asked = sorted(known) if standards is None else sorted({x.strip().lower() for x in standards if x.strip()})
        unknown = [x for x in asked if x not in known]
        if unknown:
            raise ValueError(f"no rules of {', '.join(unknown)}; there are those of {', '.join(sorted(known))}")
        wanted |= {f"{x}-rules": known[x] for x in asked}
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for key, (path, graph) in wanted.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            raise FileNotFoundError(f"no such ontology: {where.toString()}")
        rows.append((key, path, graph, fs.makeQualified(where).toString()))
    named = spark.createDataFrame(rows, "key string, path string, graph string, place string")
    bodies = spark.read.format("binaryFile").load([r[3] for r in rows]) if rows else spark.createDataFrame([], "path string, content binary")
    return F.broadcast(named).join(bodies.select(F.col("path").alias("place"), F.col("content").cast("string").alias("text")), "place").select("key", "path", "graph", "text")


def replace_graphs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing triples without the graphs that new ones come for, and the new ones."""
    return existing.join(new.select("graph").distinct(), "graph", "left_anti").select(new.columns).union(new)
