"""Splitting of source files into chunks: fixed windows, Markdown sections, XML segments and XSD declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

CHUNK, OVERLAP = 1200, 200
HEADING = r"^#{1,3}\s+\S"


def window_chunks(docs: DataFrame, key: str, body: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, position, chunk_text, chunk_type, heading) of fixed windows."""
    flat = docs.select(key, T.squeezed(body).alias("flat"))
    cut = flat.select(key, F.posexplode(T.windows_of(F.col("flat"), size, overlap)).alias("position", "chunk_text"))
    return cut.select(key, F.col("position").cast("long").alias("position"), "chunk_text", F.lit("prose").alias("chunk_type"), F.lit("").alias("heading"))


def markdown_sections(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, section, heading, section_text): lines up to the next heading, within a row; empty sections are left out."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), T.text(body)), r"\n(#{1,3}\s+\S)", "\u0000\n$1")
    parts = F.posexplode(F.split(marked, "\u0000")).alias("section", "raw")
    out = docs.select(key, parts).withColumn("raw", F.regexp_replace("raw", "^\n", ""))
    line = F.regexp_extract("raw", r"^([^\n]*)", 1)
    heading = F.when(line.rlike(HEADING), F.trim(F.regexp_replace(line, "^#+", ""))).otherwise("")
    out = out.select(key, F.col("section").cast("long").alias("section"), heading.alias("heading"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("section_text"))
    return out.where("section_text <> ''")


def markdown_chunks(docs: DataFrame, key: str, body: str, size: int = CHUNK) -> DataFrame:
    """Sections, long ones split into prose windows with a sixth as overlap."""
    parts = markdown_sections(docs, key, body).withColumn("flat", T.squeezed("section_text"))
    short = F.length("section_text") <= size
    kind = F.when(short & (F.col("heading") != ""), "heading_section").otherwise("prose")
    pieces = F.when(short, F.array("section_text")).otherwise(T.windows_of(F.col("flat"), size, size // 6))
    cut = parts.select(key, "section", "heading", kind.alias("chunk_type"), F.posexplode(pieces).alias("i", "chunk_text"))
    order = Window.partitionBy(key).orderBy("section", "i")
    return cut.select(key, (F.row_number().over(order) - 1).cast("long").alias("position"), "chunk_text", "chunk_type", "heading")


def packed(parts: list[str], size: int) -> list[str]:
    """Parts joined by line breaks while they stay within a size."""
    out, held = [], ""
    for part in parts:
        if held and len(held) + len(part) > size:
            out.append(held.rstrip())
            held = part
        else:
            held = f"{held}\n{part}".lstrip("\n") if held else part
    return [*out, held.rstrip()] if held.strip() else out


def split_xml(body: str, size: int = CHUNK) -> list[str]:
    """Segments that begin with a tag at no or two blanks, packed; packs over three times the size are packed anew by line."""
    lines = body.split("\n")
    starts = [0, *(i for i, line in enumerate(lines) if i and re.match(r"(?:  )?<(?![?!/])\w", line))]
    segments = ["\n".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    out = []
    for chunk in packed([s for s in segments if s.strip()], size):
        out += [chunk] if len(chunk) <= 3 * size else packed(chunk.split("\n"), size)
    return out


XS = "{http://www.w3.org/2001/XMLSchema}"
KINDS = ("element", "complexType", "simpleType")


def name_of(node) -> str:
    return (node.get("ref") or node.get("name") or node.get("type") or "").strip()


def distinct(names: Iterator[str], most: int = 12) -> list[str]:
    return list(dict.fromkeys(n for n in names if n))[:most]


def declaration(node) -> dict:
    """What a top-level declaration says of itself."""
    found = lambda path: node.findall(path.replace("xs:", XS))
    inner = [*found("./xs:complexType/xs:sequence/xs:element"), *found("./xs:complexType/xs:choice/xs:element")]
    attributes = found("./xs:complexType/xs:attribute")
    bases = [node.get("type"), *(x.get("base") for x in found("./xs:simpleType/xs:restriction")[:1]), *(x.get("base") for x in found("./xs:complexContent/xs:extension")[:1])]
    notes = (" ".join((x.text or "").split()) for x in found(".//xs:annotation/xs:documentation"))
    return {
        "declaration_type": node.tag.removeprefix(XS),
        "declaration_name": (node.get("name") or node.get("ref") or "").strip(),
        "base_type": next((b for b in bases if b), ""),
        "child_elements": distinct(map(name_of, inner)),
        "required_child_elements": distinct(name_of(x) for x in inner if (x.get("minOccurs") or "1").strip() != "0"),
        "attributes": distinct(f"{name_of(x)} ({x.get('use')})" if x.get("use") and name_of(x) else name_of(x) for x in attributes),
        "required_attributes": distinct(name_of(x) for x in attributes if (x.get("use") or "").strip() == "required"),
        "documentation": next((n for n in notes if n), ""),
    }


def declarations(body: str | None, most: int = 250) -> list[dict] | None:
    """Top-level elements, complex types, then simple types; None if the text isn't XML."""
    try:
        root = ElementTree.fromstring(body or "")
    except ElementTree.ParseError:
        return None
    nodes = [n for kind in KINDS for n in root.findall(f"./{XS}{kind}")]
    return [d for d in map(declaration, nodes[:most]) if d["declaration_name"]]


def summary(d: dict, source: str) -> str:
    lines = [("Base or referenced type", d["base_type"]), ("Direct child elements", ", ".join(d["child_elements"])), ("Attributes", ", ".join(d["attributes"])), ("Documentation", d["documentation"])]
    return "\n".join([f"Schema declaration: {d['declaration_type']} {d['declaration_name']}", f"Defined in: {source}", *(f"{k}: {v}" for k, v in lines if v)])


def split_windows(body: str, size: int, overlap: int) -> list[str]:
    body = " ".join(body.split())
    overlap = max(0, size // 5) if overlap >= size else overlap
    count = 1 + max(0, -(-(len(body) - size) // (size - overlap)))
    return [x for i in range(count if body else 0) if (x := body[i * (size - overlap) :][:size].strip())]


def split_xsd(body: str, source: str) -> list[tuple[str, str]]:
    """(text, heading) of declarations, or of the first three windows of what has none."""
    found = declarations(body)
    return [(summary(d, source), d["declaration_name"]) for d in found or ()] or [(x, source) for x in split_windows(body, 800, 120)[:3]]


def markup_chunks(files: DataFrame, key: str, path: str, body: str, size: int = CHUNK) -> DataFrame:
    """Chunks of .xml and .xsd files; parsers need Python, and a row is one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, p, b in zip(rows["k"], rows["p"], rows["b"], strict=True):
                b = b or ""
                name = (p or "").rsplit("/", 1)[-1] or "schema"
                pieces = split_xsd(b, name) if (p or "").lower().endswith(".xsd") else [(x, "") for x in split_xml(b, size)]
                out += [(k, i, text, "schema_fragment", heading) for i, (text, heading) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["k", "position", "chunk_text", "chunk_type", "heading"])

    kind = dict(files.dtypes)[key]
    cut = files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(body).alias("b")).mapInPandas(run, f"k {kind}, position long, chunk_text string, chunk_type string, heading string")
    return cut.withColumnRenamed("k", key)


def chunks(files: DataFrame, key: str = "source_path", path: str = "source_path", body: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All files by the splitter of their extension."""
    lower = F.lower(F.col(path))
    md, markup = lower.endswith(".md"), lower.endswith(".xml") | lower.endswith(".xsd")
    return markdown_chunks(files.where(md), key, body, size).union(markup_chunks(files.where(markup), key, path, body, size)).union(window_chunks(files.where(~md & ~markup), key, body, size, overlap))


SCHEMA = "declaration_type string, declaration_name string, base_type string, child_elements array<string>, required_child_elements array<string>, attributes array<string>, required_attributes array<string>, documentation string"


def schema_metadata(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, declaration...) of XSD files; texts that aren't XML have none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, d) for k, b in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) for d in declarations(b) or ()]
            lists = ("child_elements", "required_child_elements", "attributes", "required_attributes")
            columns = [pa.array([d[n] for _, d in rows], pa.list_(pa.string()) if n in lists else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch[0].type), *columns], ["k", *names])

    out = files.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInArrow(run, f"k {dict(files.dtypes)[key]}, {SCHEMA}")
    return out.withColumnRenamed("k", key)
