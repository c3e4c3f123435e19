"""Rule-based understanding of short queries and of documents: intent, expansion, stems, entities and plans.

Everything is built-in expressions. Null texts give nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagitta.operators import ordering

# The words and patterns of each intent, tried in this order.
DEFINITIONAL = ["what is", "what are", "define", "definition of", "meaning of"]
PROCEDURAL = ["how to", "how do", "steps", "guide", "tutorial", "process", "procedure"]
COMPARATIVE = ["compare", "vs", "versus", "difference", "similarities", "better", "worse", "similar to"]
CAUSAL = ["why", "cause", "reason", "because", "leads to", "results in"]
AGGREGATIONAL = ["list", "all", "every", "examples of", "types of"]
TEMPORAL = ["when", "date", "year", "time", "recent", "latest", "current", "history"]
FACTUAL = ["what", "who", "where", "which", "how many", "how much"]
MULTI_HOP = ["of the", "from the", "by the", "in the", "who was", "what was", "which was"]

# Synonyms, tried in this order.
SYNONYMS = {
    "fast": ["quick", "rapid", "speedy", "swift"],
    "big": ["large", "huge", "massive", "enormous"],
    "important": ["significant", "crucial", "critical", "essential"],
    "good": ["excellent", "great", "superior", "fine"],
    "start": ["begin", "initiate", "commence", "launch"],
}
EXPANSIONS = 5
CONNECTORS = ("of", "the", "and")

INTENTS = [
    ("Definitional", DEFINITIONAL, True),
    ("Procedural", PROCEDURAL, False),
    ("Comparative", COMPARATIVE, False),
    ("Causal", CAUSAL, False),
    ("Aggregational", AGGREGATIONAL, True),
    ("Temporal", TEMPORAL, False),
    ("Factual", FACTUAL, True),
]


def _any(text: Column, words: list[str], at_start: bool) -> Column:
    return reduce(lambda a, b: a | b, (text.startswith(w) if at_start else text.contains(w) for w in words))


def intent(text: Column) -> Column:
    """The first intent whose words the text starts with or contains; a question is factual, else Unknown."""
    low = F.lower(text)
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, words, at_start in INTENTS:
        out = out.when(_any(low, words, at_start), name)
    return out.when(low.endswith("?"), "Factual").otherwise("Unknown")


def expansions(text: Column, most: int = EXPANSIONS) -> Column:
    """The text, then its lower case with each known word replaced by each synonym: different ones, most at most."""
    low = F.lower(text)
    made = [F.when(low.contains(word), F.replace(low, F.lit(word), F.lit(s))) for word, synonyms in SYNONYMS.items() for s in synonyms]
    return F.slice(F.array_distinct(F.filter(F.array(text, *made), lambda x: x.isNotNull())), 1, most)


def variations(word: Column) -> Column:
    """The word, then its lower case without the endings ing, ed, s and es, where it has them."""
    low = F.lower(word)

    def without(ending: str, longer_than: int) -> Column:
        return F.when(low.endswith(ending) & (F.length(low) > longer_than), F.substr(low, F.lit(1), F.length(low) - len(ending)))

    return F.filter(F.array(word, without("ing", 0), without("ed", 0), without("s", 1), without("es", 2)), lambda x: x.isNotNull())


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def query_entities(text: Column) -> Column:
    """Runs of capitalised words, with of, the and and inside or after them, of more than two bytes.

    A run does not begin with the first word of the text nor with a word all in capitals.
    """
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}\s]", " "), r"\s+"), lambda w: w != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("run"), F.lit(0).alias("n"))

    def turn(s: Column, w: Column) -> Column:
        grows = (s.run != "") & (_capital(w) | w.isin(*CONNECTORS))
        begins = _capital(w) & (s.n > 0) & ~w.rlike(r"^\p{Lu}+$")
        ended = F.when(~grows & (s.run != ""), F.concat(s.done, F.array(s.run))).otherwise(s.done)
        run = F.when(grows, F.concat(s.run, F.lit(" "), w)).when(begins, w).otherwise("")
        return F.struct(ended.alias("done"), run.alias("run"), (s.n + 1).alias("n"))

    found = F.aggregate(words, state, turn, lambda s: F.when(s.run != "", F.concat(s.done, F.array(s.run))).otherwise(s.done))
    return F.filter(found, lambda e: F.octet_length(e) > 2)


def document_entities(text: Column) -> Column:
    """Runs of words that begin with a capital letter, as they stand, between white space."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\S)(\p{Lu}\S*(?:\s+\p{Lu}\S*)*)"), F.lit(1))


def context(rows: DataFrame, by: str, order: str, before: int = 1, after: int = 1) -> DataFrame:
    """rows with arrays before and after: what stands in the order column that many rows around, nearest last and first.

    The rows of a by are worked on in blocks, each with its neighbours' ends.
    """
    at = ordering.blocks(rows, [by], [order], before, after)
    along = Window.partitionBy(by, "_block").orderBy("_no")
    found = at.withColumns({"before": F.collect_list(order).over(along.rowsBetween(-before, -1)), "after": F.collect_list(order).over(along.rowsBetween(1, after))})
    return found.where("not _guest").drop("_block", "_guest", "_no")


def is_multi_hop(text: Column) -> Column:
    return _any(F.lower(text), MULTI_HOP, False) | (F.size(query_entities(text)) > 2)


STEP = "array<struct<query:string,dependencies:array<int>,step_type:string>>"


def plan(text: Column, of_intent: Column | None = None) -> Column:
    """For a multi-hop text of two entities or more: the steps to answer it; null for others."""
    found = query_entities(text)
    kind = intent(text) if of_intent is None else of_intent
    step = lambda q, deps, t: F.struct(q.alias("query"), deps.alias("dependencies"), F.lit(t).alias("step_type"))
    none = F.array().cast("array<int>")
    compared = F.array(
        step(found[0], none, "Retrieve"),
        step(found[1], none, "Retrieve"),
        step(F.concat(F.lit("Compare "), found[0], F.lit(" vs "), found[1]), F.array(F.lit(0), F.lit(1)), "Aggregate"),
    )
    chain = F.transform(found, lambda e, i: step(e, F.when(i > 0, F.array(i - 1)).otherwise(none), "Retrieve"))
    return F.when(is_multi_hop(text) & (F.size(found) >= 2), F.when(kind == "Comparative", compared).otherwise(chain)).cast(STEP)


def analysis(text: Column) -> Column:
    """intent, expansions and plan in one struct."""
    return F.struct(intent(text).alias("intent"), expansions(text).alias("expansions"), plan(text).alias("plan"))
