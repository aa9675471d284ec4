"""Spelling of questions, held against the words of a corpus.

A word is looked up by its deletion neighbourhood: two words at most two edits apart (insertion, deletion, replacement, swap of
neighbours) share a string that is left of both when up to two letters are taken out, even if only their first `head` letters
are looked at. So unknown words meet candidates by equality, and each pair's distance is computed once.

Technical words stay: fixed names, words beginning with a capital, tags, names with underscores, and all that isn't letters alone.
Defined results: null or empty questions stay as they are; a question in no known language stays; ties between candidates go to
the word of more documents, then to the smaller one. A question without changes keeps its white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.session import cut

# Names that are never corrected.
TECHNICAL = (
    "ServiceJourney", "DatedServiceJourney", "ScheduledStopPoint", "StopPlace", "JourneyPattern", "ServiceCalendar", "RouteLink", "TimingLink", "OperatingDay", "OperatingPeriod",
    "VehicleJourney", "DayType", "AccessibilityLimitation", "SiteConnection", "TariffZone", "NeTEx", "SIRI", "OpRa", "XML", "JSON", "URI", "URL", "API", "UTC", "ISO", "GTFS", "OSM", "WGS84",
)
# Fixed value: marks stripped off words.
MARKS = r"[.,;:!?\"']+"


def without(word: Column) -> Column:
    """The strings left when one letter is taken out."""
    n = F.length(word)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, n)))


def deletions(word: Column, most: int = 2, head: int = 10) -> Column:
    """The first `head` letters, and what is left of them without up to `most` letters; at most 1 + 10 + 45 strings for 10 and 2."""
    level = F.array(word.substr(1, head))
    out = level
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, without)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def swaps(word: Column) -> Column:
    """The word with two neighbours swapped, for each pair of them."""
    n = F.length(word)
    at = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1)), word.substr(i + 2, n)))
    return F.when(n > 1, at).otherwise(F.array().cast("array<string>"))


def distance(a: Column, b: Column) -> Column:
    """1 or 2 edits between two different words, swaps of neighbours among them; null beyond."""
    plain = F.levenshtein(a, b, 4)  # a swap is at most two plain edits
    swapped, other = swaps(a), swaps(b)
    two = F.exists(swapped, lambda s: F.levenshtein(s, b, 1) >= 0) | F.exists(other, lambda s: F.levenshtein(a, s, 1) >= 0) | F.arrays_overlap(swapped, other)
    return F.when(plain == 1, 1).when((plain == 2) & F.array_contains(swapped, b), 1).when(plain == 2, 2).when((plain > 2) & two, 2)


def lexicon(chunks: DataFrame, least: int = 5) -> DataFrame:
    """(lang, word, documents): lower-case words that at least `least` rows (text, lang) hold. A null language is ''."""
    words = F.array_distinct(T.found(F.lower(T.text("text")), r"\p{L}+"))
    rows = chunks.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words).alias("word"))
    return rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least)


def placed(questions: DataFrame) -> DataFrame:
    """(question_id, place, token, clean, word): the words of questions, without marks, and in lower case."""
    tokens = F.split(T.squeezed("question"), " ")
    return questions.select("question_id", F.posexplode(tokens).alias("place", "token")).withColumn("clean", F.regexp_replace("token", f"^{MARKS}|{MARKS}$", "")).withColumn("word", F.lower("clean"))


def correctable(clean: Column) -> Column:
    return clean.rlike(r"^\p{L}+$") & ~clean.rlike(r"^[\p{Lu}\p{Lt}]") & ~clean.isin(*TECHNICAL)


def languages(words: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, lang): the language that knows most words of a question; ties go to the smaller name. Without any: no row."""
    hits = words.join(known.select("lang", "word"), "word").groupBy("question_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    return hits.groupBy("question_id").agg(F.min(F.struct(-F.col("n"), F.col("lang"))).alias("best")).select("question_id", "best.lang")


def corrections(words: DataFrame, known: DataFrame, most: int = 2, head: int = 10) -> DataFrame:
    """(lang, word, correction, distance) of unknown words (lang, word): the nearest known word, then that of more documents.

    Only distinct unknown words are looked up; a pair that shares several strings is counted within each task before it is shuffled.
    """
    if most not in (1, 2) or head <= most:
        raise ValueError("most is 1 or 2, and less than head")
    unknown = words.select("lang", "word").distinct().join(known, ["lang", "word"], "left_anti")
    asked = unknown.withColumn("key", F.explode(deletions(F.col("word"), most, head)))
    held = known.select("lang", F.col("word").alias("correction"), "documents", F.explode(deletions(F.col("word"), most, head)).alias("key"))
    far = F.levenshtein("word", "correction", 2 * most) < 0  # a swap is at most two plain edits
    near = asked.join(held, ["lang", "key"]).where((F.abs(F.length("word") - F.length("correction")) <= most) & ~far)
    near = near.groupBy("lang", "word", "correction", "documents").agg(F.count(F.lit(1)).alias("shared"))  # a pair once, whatever it shares
    near = near.withColumn("distance", distance(F.col("word"), F.col("correction"))).where(F.col("distance") <= most)
    best = near.groupBy("lang", "word").agg(F.min(F.struct("distance", -F.col("documents"), "correction")).alias("b"))
    return best.select("lang", "word", "b.correction", "b.distance")


def corrected(questions: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """questions (question_id, question) with `corrected` and the number of `changes`; ids are unique."""
    known = cut(known)  # read three times, and made of the whole corpus
    words = placed(questions)
    own = cut(words.where(correctable(F.col("clean"))).join(languages(words, known), "question_id"))
    fixes = own.join(cut(corrections(own, known, most)), ["lang", "word"])  # cut, so that a common word can be split
    by_place = F.map_from_entries(F.collect_list(F.struct("place", F.replace("token", "clean", "correction"))))
    fixes = fixes.groupBy("question_id").agg(by_place.alias("_fixes"))  # at most the words of one question
    out = questions.join(fixes, "question_id", "left")
    tokens = F.transform(F.split(T.squeezed("question"), " "), lambda t, i: F.coalesce(F.try_element_at("_fixes", i), t))
    whole = F.when(F.col("_fixes").isNull(), F.col("question")).otherwise(F.concat_ws(" ", tokens))
    return out.withColumn("corrected", whole).withColumn("changes", F.coalesce(F.size("_fixes"), F.lit(0)).cast("long")).drop("_fixes")
