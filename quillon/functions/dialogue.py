"""Column functions around an answer: questions in one form, evidence blocks for a prompt, decisions of a controller, names of concepts and examples."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import text as T

# Mark of a shortened text, and the scope named where a question has none.
SHORTENED = "\n...[truncated for latency]"
ALL_STANDARDS = "all approved standards"
# Standards by a part of a concept's address, in this order.
ADDRESS_PARTS = (("netex", "NeTEx"), ("opra", "OpRa"), ("siri", "SIRI"), ("transmodel", "Transmodel"))
# Standards that have a store of their own.
STORED = ("netex", "siri", "opra")
ROUTES = ("faq", "rag")


# ---- questions ----------------------------------------------------------------------------------------------------


def normalized(c: Column | str) -> Column:
    """A text in compatibility form (NFKC), white space squeezed; null is empty. Only texts beyond ASCII go through Python."""
    t = T.text(c)

    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t else t)

    plain = t.rlike(r"\A\p{ASCII}*\z")
    return T.squeezed(F.when(plain, t).otherwise(F.pandas_udf(nfkc, StringType())(F.when(~plain, t))))


# ---- prompts ------------------------------------------------------------------------------------------------------


def shortened(c: Column | str, most: int) -> Column:
    """The first `most` characters of a longer text, without blanks at the end, and a mark; 0 or less takes all."""
    t = T.text(c)
    if most <= 0:
        return t
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(t.substr(1, most), r"[\s\x1C-\x1F\x85\xA0]+$", ""), F.lit(SHORTENED)))


def evidence_block(nth: Column, repository: Column, commit: Column, path: Column, chunk: Column, body: Column, most: int = 1800) -> Column:
    """One chunk as lines, each with the marker [E#] of its number."""
    fields = (("repository", repository), ("commit", commit), ("source", path), ("chunk", chunk), ("text", shortened(body, most)))
    return F.concat_ws("\n", *(F.concat(F.lit("[E"), nth.cast("string"), F.lit(f"] {k}="), T.text(v.cast("string"))) for k, v in fields))


def user_prompt(question: Column, scope: Column, blocks: Column, faq_hint: Column | None = None) -> Column:
    """Question, scope, an approved answer if there is one, and evidence blocks in order, apart by empty lines."""
    named = F.when(F.coalesce(F.size(scope), F.lit(0)) > 0, F.array_join(scope, ", ")).otherwise(ALL_STANDARDS)
    hint = F.lit(None).cast("string") if faq_hint is None else F.when(T.text(faq_hint) != "", F.concat(F.lit("Editorial baseline:\n"), faq_hint))
    return F.concat_ws("\n\n", F.concat(F.lit("Question:\n"), T.text(question)), F.concat(F.lit("Requested scope: "), named), hint, F.concat(F.lit("Evidence blocks:\n"), F.array_join(blocks, "\n\n")))


# ---- controller ---------------------------------------------------------------------------------------------------


def payload(c: Column | str) -> Column:
    """The last flat JSON object of a text that names a route and a confidence, as a variant; null where there is none."""
    whole = F.filter(T.found(T.text(c), r"\{[\s\S]*?\}"), lambda t: t.contains('"route"') & t.contains('"confidence"'))
    return F.try_element_at(F.filter(F.transform(whole, F.try_parse_json), lambda v: v.isNotNull()), F.lit(-1))


def decision(p: Column) -> Column:
    """(route, intent, confidence, error) of a payload.

    A route that holds `rag` is rag, one that holds only `faq` is faq; confidence is clamped to 0..1 and 0 if absent. The error is
    `payload`, `route` or `confidence` for what is missing or can't be read, and then the rest is null.
    """
    of = lambda k, kind="string": F.try_variant_get(p, f"$.{k}", kind)
    said = F.lower(F.trim(F.coalesce(of("route"), F.lit(""))))
    route = F.when(said.contains("rag"), "rag").when(said.contains("faq"), "faq")
    given = F.coalesce(of("confidence").try_cast("double"), of("confidence", "boolean").cast("double"), F.when(F.to_json(p).rlike('"confidence"\\s*:'), F.lit(None)).otherwise(0.0))
    intent = F.trim(F.coalesce(of("intent"), F.lit("unknown")))
    error = F.when(p.isNull(), "payload").when(route.isNull(), "route").when(given.isNull(), "confidence")
    clamped = F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))
    ok = lambda v, name: F.when(error.isNull(), v).alias(name)
    return F.struct(ok(route, "route"), ok(F.when(intent == "", "unknown").otherwise(intent), "intent"), ok(clamped, "confidence"), error.alias("error"))


# ---- names --------------------------------------------------------------------------------------------------------


def address_standard(iri: Column | str, default: str = "Ontology") -> Column:
    """Standard of a concept's address by the first part found, whatever the case."""
    out = F.lit(default)
    for part, name in reversed(ADDRESS_PARTS):
        out = F.when(T.lowered(iri).contains(part), name).otherwise(out)
    return out


def address_name(iri: Column | str) -> Column:
    """What follows the first # up to the next, or the last slash where there is no #."""
    i = T.text(iri)
    return F.when(i.contains("#"), F.split_part(i, F.lit("#"), F.lit(2))).otherwise(F.regexp_extract(i, "([^/]*)$", 1))


def standard_form(c: Column | str) -> Column:
    return F.lower(F.trim(T.text(c)))


def stored_standards(scope: Column, hinted: Column) -> Column:
    """Standards with a store among those of scope and question, sorted."""
    none = F.array().cast("array<string>")
    forms = F.transform(F.concat(F.coalesce(scope, none), F.coalesce(hinted, none)), standard_form)
    return F.array_sort(F.array_distinct(F.filter(forms, lambda s: s.isin(*STORED))))


def element_label(c: Column | str) -> Column:
    """An element's name as lower-case words."""
    return F.lower(F.regexp_replace(T.text(c), "(?<=[a-z])(?=[A-Z])", " "))


def instance_name(path: Column | str) -> Column:
    """Name of an example's node: the parts of its file's stem, each with one capital, without number prefixes."""
    name = F.regexp_extract(T.text(path), "([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"^[Nn]e[Tt]ex_[\d.]+_", ""), "^ENTUR[-_]", "Entur")
    words = F.transform(F.split(stem, r"[_\-\s]+"), lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    return F.concat(F.lit("nexample:NeTEx"), F.array_join(words, ""))


def repaired_root(url: Column | str) -> Column:
    """A repository's address, cut before the path of a file where one was stored."""
    return F.split_part(T.text(url), F.lit("/blob/"), F.lit(1))
