"""Concept graph over tables: concepts (concept_id, labels, related_to, maps_to, legacy_maps_to, synonym_of), aliases, edges, triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import retrieval as R
from quillon.operators.analytics import latest_by
from quillon.session import cut


def namespace(c: Column | str) -> Column:
    return F.when(T.text(c).contains(":"), F.lower(F.split_part(T.text(c), F.lit(":"), F.lit(1)))).otherwise("")


def local_name(c: Column | str) -> Column:
    return F.regexp_replace(T.text(c), "^[^:]*:", "")


def slug(c: Column) -> Column:
    return F.array_join(F.slice(T.plain_tokens(c), 1, 8), "-")


def core_target(c: Column) -> Column:
    """A mapping target in the core namespace (or its legacy name) in canonical form, else null."""
    ok = namespace(c).isin("nits", "nch") & (slug(local_name(c)) != "")
    return F.when(ok, F.concat(F.lit("nits:"), slug(local_name(c))))


def aliases(concepts: DataFrame) -> DataFrame:
    """(concept_id, alias) in match form: labels and the local name."""
    local = F.array(F.regexp_replace(local_name("concept_id"), "([a-z0-9])([A-Z])", "$1 $2"))
    names = F.explode(F.concat(F.coalesce("labels", F.array().cast("array<string>")), local))
    return concepts.select("concept_id", names.alias("n")).select("concept_id", T.match_form("n").alias("alias")).where("alias <> ''").distinct()


def canonical_terms(names: DataFrame) -> DataFrame:
    """The longest alias of each concept; the last in order among equally long ones."""
    return names.groupBy("concept_id").agg(F.max_by("alias", F.struct(F.length("alias"), "alias")).alias("term"))


#: Aliases checked beside one copy of a text.
SLICE = 1000


def alias_keys(names: DataFrame, words: DataFrame) -> DataFrame:
    """(alias, key): words of which a text that matches an alias holds one. words: key, n texts that hold it.

    A one-token alias needs its token, one of three or more all but its ends, by whichever rule it matches: the rarest is its key.
    Of a two-token alias the first ends a word and the second begins one, so either the words with that end or those with
    that beginning are its keys, whichever fewer texts hold. They are found among the distinct words, not in texts.
    """
    parts = names.select("alias").distinct().withColumn("p", F.split("alias", " "))
    inner = F.when(F.size("p") == 1, F.col("p")).otherwise(F.slice("p", 2, F.greatest(F.size("p") - 2, F.lit(1))))
    tokens = parts.where("size(p) > 2 OR size(p) = 1 AND length(alias) > 2").select("alias", F.explode(F.array_distinct(inner)).alias("key"))
    rarest = tokens.join(words, "key").groupBy("alias").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    sides = []
    for side, of in enumerate(("right", "left")):
        own = parts.where("size(p) = 2").select("alias", F.col("p")[side].alias("part"))
        sizes = own.select(F.length("part").alias("size")).distinct()  # lengths of tokens
        ends = words.join(F.broadcast(sizes), F.length("key") >= F.col("size")).select("key", "n", F.expr(f"{of}(key, size)").alias("part"))
        sides.append(ends.join(own, "part").select("alias", F.lit(side).alias("side"), "key", "n"))
    both = sides[0].union(sides[1])
    cost = both.groupBy("alias", "side").agg(F.sum("n").alias("n")).groupBy("alias").agg(F.min_by("side", F.struct("n", "side")).alias("side"), F.count("*").alias("sides")).where("sides = 2")
    return rarest.union(both.join(cost, ["alias", "side"]).select("alias", "key"))


def mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(chunk_id, concept_id) of aliases that occur in chunk texts.

    Texts meet aliases by equality of a word (`alias_keys`). Candidates are verified by the alias rules, up to SLICE aliases
    beside each copy of a text.
    """
    # a generated column is made once a row; explode_outer adds no filter that would split the texts twice
    body = chunks.select("chunk_id", F.explode(F.array(T.match_form("text"))).alias("body"))
    names = names.where("alias <> ''").select("concept_id", "alias").distinct()
    words = body.select("chunk_id", F.explode_outer(F.array_distinct(F.split("body", " "))).alias("key"))
    keys = R.small(cut(alias_keys(names, cut(words.groupBy("key").agg(F.count("*").alias("n"))))))  # words are counted once
    nth = F.dense_rank().over(Window.partitionBy("chunk_id").orderBy("alias"))
    candidates = words.join(keys, "key").select("chunk_id", "alias").withColumn("slice", F.floor((nth - 1) / SLICE))
    sliced = candidates.groupBy("chunk_id", "slice").agg(F.collect_set("alias").alias("aliases"))
    checked = sliced.join(body, "chunk_id").withColumn("padded", F.concat(F.lit(" "), "body", F.lit(" ")))
    held = F.filter("aliases", lambda a: T.alias_matches(a, F.col("body"), F.col("padded")))
    return checked.select("chunk_id", F.explode_outer(held).alias("alias")).join(names, "alias").select("chunk_id", "concept_id").distinct()


def core_mapping(concepts: DataFrame, core: DataFrame | None = None, rounds: int = 6) -> DataFrame:
    """(concept_id, core_id): explicit, legacy, inherited from a synonym, an exact label of the core, or a slug of the label.

    Synonyms are followed `rounds` steps with doubling, so chains of 2**rounds are resolved and cycles end in the fallback.
    """
    own = F.when(namespace("concept_id").isin("nits", "nch"), F.concat(F.lit("nits:"), local_name("concept_id")))
    label = F.coalesce(F.try_element_at("labels", F.lit(1)), F.regexp_replace(local_name("concept_id"), "([a-z0-9])([A-Z])", "$1 $2"))
    fallback = F.concat(F.lit("nits:"), F.when(slug(label) != "", slug(label)).when(slug(local_name("concept_id")) != "", slug(local_name("concept_id"))).otherwise("concept"))
    known = F.coalesce(own, core_target(F.col("maps_to")), core_target(F.col("legacy_maps_to")))
    base = concepts.select("concept_id", known.alias("known"), fallback.alias("fallback"), "synonym_of", "labels")
    if core is not None:
        names = core.where(namespace("concept_id").isin("nits", "nch")).select(F.concat(F.lit("nits:"), slug(local_name("concept_id"))).alias("core_id"), F.explode(F.array_append(F.coalesce("labels", F.array().cast("array<string>")), local_name("concept_id"))).alias("n"))
        index = names.groupBy(T.match_form("n").alias("form")).agg(F.min("core_id").alias("core_id"))
        given = base.select("concept_id", F.posexplode(F.array_append(F.coalesce("labels", F.array().cast("array<string>")), local_name("concept_id"))).alias("i", "n"))
        found = given.withColumn("form", T.match_form("n")).join(index, "form").groupBy("concept_id").agg(F.min_by("core_id", "i").alias("inferred"))
        base = base.join(found, "concept_id", "left").withColumn("fallback", F.coalesce("inferred", "fallback"))
    # (concept, value or next concept): a step replaces the next concept by its own value or next
    state = base.select("concept_id", F.coalesce("known", F.when(F.col("synonym_of").isNull(), F.col("fallback"))).alias("value"), F.when(F.col("known").isNull(), F.col("synonym_of")).alias("next"), "fallback")
    state = state.join(concepts.select(F.col("concept_id").alias("next"), F.lit(True).alias("exists")), "next", "left")
    state = state.withColumn("value", F.coalesce("value", F.when(F.col("exists").isNull(), F.col("fallback")))).withColumn("next", F.when(F.col("value").isNull(), F.col("next"))).select("concept_id", "value", "next", "fallback")
    for _ in range(rounds):
        state = cut(state)
        ahead = state.select(F.col("concept_id").alias("next"), F.col("value").alias("v"), F.col("next").alias("n"))
        state = state.join(ahead, "next", "left").select("concept_id", F.coalesce("value", "v").alias("value"), F.when(F.coalesce("value", "v").isNull(), F.col("n")).alias("next"), "fallback")
    return state.select("concept_id", F.coalesce("value", "fallback").alias("core_id"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct edges (source, target) in both directions, without loops."""
    return edges.union(edges.select("target", "source")).where("source <> target").distinct()


def relation_edges(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Related concepts both ways, and concepts that share a core concept."""
    ids = concepts.select(F.col("concept_id").alias("target"))
    related = concepts.select(F.col("concept_id").alias("source"), F.explode("related_to").alias("target")).join(ids, "target", "left_semi").select("source", "target")
    a, b = (mapping.select(F.col("concept_id").alias(x), "core_id") for x in ("source", "target"))
    siblings = a.join(b, "core_id").where("source <> target").select("source", "target")
    return both_ways(related).union(siblings).distinct()


def core_edges(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Related concepts both ways, and each concept to its core concept.

    Concepts with the same core are siblings: `relation_edges` lists them as pairs, here a group has one edge a member.
    """
    ids = concepts.select(F.col("concept_id").alias("target"))
    related = concepts.select(F.col("concept_id").alias("source"), F.explode("related_to").alias("target")).join(ids, "target", "left_semi").select("source", "target")
    members = mapping.select(F.col("concept_id").alias("source"), F.col("core_id").alias("target")).where("source <> target")
    return both_ways(related).union(members).distinct()


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, by: str = "question_id") -> DataFrame:
    """(by, concept_id, hop): concepts within some hops of a group's seeds; each with its smallest hop. Each hop is cut, so the plan doesn't grow."""
    reached = cut(seeds.select(by, "concept_id").distinct().withColumn("hop", F.lit(0)))
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.join(edges.withColumnRenamed("source", "concept_id"), "concept_id").select(by, F.col("target").alias("concept_id")).distinct()
        frontier = cut(step.join(reached.select(by, "concept_id"), [by, "concept_id"], "left_anti").withColumn("hop", F.lit(h)))
        reached = reached.union(frontier)
    return reached


def expand_by_core(seeds: DataFrame, mapping: DataFrame, core_edges: DataFrame, edges: DataFrame, by: str = "question_id") -> DataFrame:
    """One hop: seeds, concepts of their core concepts and of neighbours of those, then related concepts."""
    cores = seeds.join(mapping, "concept_id").select(by, F.col("core_id").alias("concept_id"))
    wider = expand(cores, core_edges, 1, by).select(by, F.col("concept_id").alias("core_id"))
    via_core = wider.join(mapping, "core_id").select(by, "concept_id")
    related = expand(seeds, edges, 1, by).select(by, "concept_id")
    return via_core.union(related).distinct()


def snapshot(chunks: DataFrame, mentioned: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property graph over chunks that mention a concept."""
    named = chunks.join(mentioned.select("chunk_id").distinct(), "chunk_id", "left_semi")
    repository = F.concat(F.lit("repository:"), F.sha1(F.col("repository_url").cast("binary")).substr(1, 16))
    document = F.concat(F.lit("document:"), F.sha1(F.concat_ws("|", "repository_url", "source_path").cast("binary")).substr(1, 20))
    chunk, concept = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), F.concat(F.lit("concept:"), F.col("concept_id"))
    rows = named.select(repository.alias("r"), document.alias("d"), chunk.alias("c"))
    nodes = [rows.select(F.lit(k).alias("type"), F.col(c).alias("id")).distinct() for k, c in (("Repository", "r"), ("Document", "d"), ("Chunk", "c"))]
    nodes.append(mentioned.select(F.lit("Concept").alias("type"), concept.alias("id")).distinct())
    held = mentioned.select("concept_id").distinct()
    inner = edges.join(held.select(F.col("concept_id").alias("source")), "source", "left_semi").join(held.select(F.col("concept_id").alias("target")), "target", "left_semi")
    links = [
        rows.select(F.lit("CONTAINS_DOCUMENT").alias("type"), F.col("r").alias("source"), F.col("d").alias("target")),
        rows.select(F.lit("HAS_CHUNK"), "d", "c"),
        mentioned.join(named.select("chunk_id"), "chunk_id", "left_semi").select(F.lit("MENTIONS_CONCEPT"), chunk, concept),
        inner.select(F.lit("RELATED_TO"), F.concat(F.lit("concept:"), F.col("source")), F.concat(F.lit("concept:"), F.col("target"))),
    ]
    return reduce(DataFrame.union, nodes), reduce(DataFrame.union, links)


def snapshot_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n)."""
    count = F.count("*").alias("n")
    return nodes.groupBy(F.lit("node").alias("kind"), "type").agg(count).union(edges.groupBy(F.lit("edge").alias("kind"), "type").agg(count))


# ---- triples ------------------------------------------------------------------------------------------------------

# Namespaces of the standards' concepts; both spellings of one standard map to one prefix.
PREFIXES = (
    ("http://www.netex.org.uk/netex#", "netex"), ("https://siri.org.uk/siri/1.3#", "siri"), ("http://www.siri.org.uk/siri/2.1#", "siri"),
)


def concept_of(iri: Column, prefixes=PREFIXES) -> Column:
    """Concept id of an IRI by prefix, else null."""
    out = F.lit(None).cast("string")
    for full, short in prefixes:
        out = F.when(iri.startswith(full), F.concat(F.lit(f"{short}:"), iri.substr(F.lit(len(full) + 1), F.length(iri)))).otherwise(out)
    return out


def edges_of(triples: DataFrame, predicates=("related", "relatedMatch", "exactMatch"), graphs=None) -> DataFrame:
    """Both-way edges of triples whose predicate's local name is one of those, within named graphs if given."""
    if graphs is not None:
        triples = triples.where(F.col("graph").isin(*graphs))
    name = F.regexp_extract("p", "([^#/:]*)$", 1)
    return both_ways(triples.where(name.isin(*predicates) & (F.col("o_kind") == "iri")).select(F.col("s").alias("source"), F.col("o").alias("target")))


def graph_components(edges: DataFrame, *by: str) -> DataFrame:
    """(by, node, component): the connected components of (by, source, target) edges, each named by its least node; nodes without an edge are in none.

    Nodes point at the least node known to reach them, and pointers are followed two at once, so a chain of n nodes takes about
    log n rounds. Each round is cut; its joins are on (by, node).
    """
    keys = list(by)
    both = cut(edges.select(*keys, "source", "target").union(edges.select(*keys, "target", "source")).where("source <> target").distinct())
    loops = edges.where("source = target").select(*keys, F.col("source").alias("node"), F.col("source").alias("component"))
    state = cut(both.groupBy(*keys, F.col("source").alias("node")).agg(F.least(F.min("target"), F.col("source")).alias("component")))
    while True:
        ahead = state.select(*keys, F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = state.join(ahead, [*keys, "component"], "left").select(*keys, "node", F.least("component", F.coalesce("further", "component")).alias("component"))
        near = both.join(jumped.select(*keys, F.col("node").alias("target"), F.col("component").alias("c")), [*keys, "target"]).select(*keys, F.col("source").alias("node"), "c")
        # what a node learns from its neighbours, the node that it points at learns as well
        learned = near.groupBy(*keys, "node").agg(F.min("c").alias("c"))
        told = jumped.join(learned, [*keys, "node"]).select(*keys, F.col("component").alias("node"), "c").union(learned.select(*keys, "node", "c"))
        least = told.groupBy(*keys, "node").agg(F.min("c").alias("c"))
        following = cut(jumped.join(least, [*keys, "node"], "left").select(*keys, "node", F.least("component", F.coalesce("c", "component")).alias("component")))
        if following.join(state.withColumnRenamed("component", "before"), [*keys, "node"]).where("component <> before").isEmpty():
            break
        state = following
    return following.union(loops.join(following, [*keys, "node"], "left_anti").distinct())


def closure(seeds: DataFrame, triples: DataFrame, hops: int = 2, predicates=("related", "relatedMatch", "exactMatch"), graphs=None) -> tuple[DataFrame, DataFrame]:
    """(seeds, members) of what is reachable either way along predicates: (question_id, graph, component) and (graph, node, component).

    One hop takes direct neighbours, more take whole components, as the two-way predicates have no end. Within named graphs a
    path stays in one of them; without, all triples are one graph, named ''. A seed is its own member where it has an edge. Groups
    are memberships, never pairs: a question's concepts are the members of its components. For one hop a group is a seed's
    neighbourhood, named by the seed.
    """
    rows = triples.where(F.col("graph").isin(*graphs)) if graphs is not None else triples.withColumn("graph", F.lit(""))
    named = rows.where(F.regexp_extract("p", "([^#/:]*)$", 1).isin(*predicates) & (F.col("o_kind") == "iri"))
    edges = named.select("graph", F.col("s").alias("source"), F.col("o").alias("target"))
    if hops <= 1:
        both = edges.union(edges.select("graph", "target", "source")).distinct()
        own = seeds.select("question_id", F.col("concept").alias("component")).distinct()
        near = both.join(own.select(F.col("component").alias("source")).distinct(), "source", "left_semi")
        return own.join(near.select("graph", F.col("source").alias("component")).distinct(), "component").select("question_id", "graph", "component"), near.select("graph", F.col("target").alias("node"), F.col("source").alias("component"))
    members = cut(graph_components(edges, "graph"))
    asked = seeds.select("question_id", F.col("concept").alias("node")).distinct()
    return asked.join(members, "node").select("question_id", "graph", "component").distinct(), members


def definitions(triples: DataFrame) -> DataFrame:
    """(concept, label, definition, alt_labels) of subjects with a label."""
    name = F.regexp_extract("p", "([^#/:]*)$", 1)
    of = lambda n, alias: triples.where(name == n).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias(alias))
    out = of("prefLabel", "labels").join(of("definition", "definitions"), "s", "left").join(of("altLabel", "alt_labels"), "s", "left")
    return out.select(F.col("s").alias("concept"), F.col("labels")[0].alias("label"), F.try_element_at("definitions", F.lit(1)).alias("definition"), F.coalesce("alt_labels", F.array().cast("array<string>")).alias("alt_labels"))


def first_mapping(pairs: DataFrame) -> DataFrame:
    """(concept_id, core_id, is_abstract): a mapping that isn't abstract first, then by id."""
    return latest_by(pairs, ["concept_id"], F.asc("is_abstract"), F.asc("core_id"))


def evidence_chunks(rows: DataFrame, kind: str, quality: float) -> DataFrame:
    """Definitions or examples (concept, title, body) as chunks; commit_sha is ''."""
    path = F.concat(F.lit(f"{kind}/"), F.col("concept"))
    return rows.select(
        F.concat(F.lit(f"{kind}-"), F.sha1(F.concat_ws("|", "concept", "title").cast("binary")).substr(1, 24)).alias("chunk_id"),
        path.alias("source_path"), F.lit("").alias("commit_sha"), F.col("title").alias("label"), F.substring("body", 1, 2000).alias("text"), F.lit(kind).alias("doc_type"), F.lit(quality).alias("quality_score"),
    )


# Local names of the predicates that align or label concepts.
ALIGNED = ("equivalentClass", "subClassOf", "relatedMatch", "exactMatch", "closeMatch")
LABELLED = ("prefLabel", "altLabel", "label")
# Standards by a part of a concept's address; the first that fits counts.
DOMAINS = (("netex.org.uk", "NeTEx"), ("opra.org.uk", "OpRa"), ("transmodel-cen.eu/opra", "OpRa"), ("siri.org.uk", "SIRI"), ("transmodel", "Transmodel"))


def labels_of(triples: DataFrame, predicates=LABELLED) -> DataFrame:
    """(s, label) of triples whose predicate's local name is one of those."""
    return triples.where(F.regexp_extract("p", "([^#/:]*)$", 1).isin(*predicates)).select("s", F.col("o").alias("label"))


def anchored(terms: DataFrame, triples: DataFrame) -> DataFrame:
    """(question_id, core) of terms (question_id, term): what is aligned, either way, with a concept of that label, whatever the case.

    Blank terms have none.
    """
    asked = terms.where(F.trim(T.text("term")) != "").select("question_id", F.lower("term").alias("form"))
    named = labels_of(triples).select("s", F.lower("label").alias("form"))
    edges = edges_of(triples, ALIGNED).withColumnsRenamed({"source": "s", "target": "core"})
    return asked.join(named, "form").join(edges, "s").select("question_id", "core").distinct()


def standards_of(cores: DataFrame, triples: DataFrame, core: str, foreign=("www.w3.org", "purl.org")) -> DataFrame:
    """(core, standards): sorted standards of concepts aligned with a core concept, those of the core and of general vocabularies left out.

    `core` is a part of the addresses of core concepts. A concept without a known standard counts for none; cores without any are left out.
    """
    out = F.lit(None).cast("string")
    for part, name in reversed(DOMAINS):
        out = F.when(F.contains("source", F.lit(part)), name).otherwise(out)
    near = edges_of(triples, ALIGNED).join(cores.select(F.col("core").alias("target")).distinct(), "target", "left_semi")
    near = near.where(~T.contains_any(F.col("source"), (core, *foreign))).select(F.col("target").alias("core"), out.alias("standard")).where("standard IS NOT NULL")
    return near.groupBy("core").agg(F.array_sort(F.collect_set("standard")).alias("standards"))


def core_by_slug(slugs: DataFrame, triples: DataFrame, core: str) -> DataFrame:
    """(slug, core): classes of the core whose local name or label equals a slug, letters and digits alone; else those equal to a part of it."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    classes = triples.where(F.regexp_extract("p", "([^#/:]*)$", 1) == "type").where(F.col("o").endswith("owl#Class") & F.contains("s", F.lit(core))).select("s").distinct()
    local = classes.select("s", bare(F.regexp_extract("s", "#(.*)$", 1)).alias("form"))
    named = classes.join(labels_of(triples, ("prefLabel", "label")), "s").select("s", bare("label").alias("form"))
    forms = local.union(named).where("form <> ''").distinct()
    asked = slugs.select("slug", F.lower(F.trim(T.text("slug"))).alias("low")).distinct()
    exact = asked.select("slug", bare("low").alias("form")).join(forms, "form").select("slug", F.col("s").alias("core")).distinct()
    rest = asked.join(exact.select("slug").distinct(), "slug", "left_anti").select("slug", F.explode(F.split(F.replace("low", F.lit("_"), F.lit("-")), "-")).alias("form"))
    return exact.union(rest.join(forms, "form").select("slug", F.col("s").alias("core"))).distinct()
