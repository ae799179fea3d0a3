"""Full-text search.

Callers compose conditions with ``term``, ``prefix``, ``phrase``, ``near``,
``all_of``, ``any_of`` and ``but_not``.  A condition is a test of a row's token text, so
a search is one narrow scan however many words it has, and it sits beside scopes and
filters in one ``where``.  For batches of queries there is a postings table, to be
written once and joined by term.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.scratch import written

_TOKEN = re.compile(r"[^\W_]+")

#: A test of the token texts of a row's columns.
Condition = Callable[[dict[str, Column]], Column]


class QueryError(ValueError):
    """A condition that is not well formed."""


def _planned(condition: Condition, *plan) -> Condition:
    """A condition that also tells what it is made of, for evaluation on an index."""
    condition.plan = plan
    return condition


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


def _each(test: Callable[[Column], Column], column: str | None) -> Condition:
    """``test`` in one column, or in any of them."""

    def run(tokens: dict[str, Column]) -> Column:
        if column is not None and column not in tokens:
            raise QueryError(f"no column {column!r}")
        own = [tokens[column]] if column else list(tokens.values())
        return reduce(lambda a, b: a | b, [F.coalesce(test(t), F.lit(False)) for t in own])

    return run


def _one_or_more(text: str) -> list[str]:
    if not (found := words_of(text)):
        raise QueryError(f"{text!r} has no word")
    return found


def _test(tokens: Column, words: list[str], prefix: bool = False, first: bool = False) -> Column:
    """Adjacent tokens, the last one by its beginning if ``prefix``, from the start if ``first``."""
    wanted = " " + " ".join(words) + ("" if prefix else " ")
    return tokens.startswith(wanted) if first else tokens.contains(wanted)


def term(text: str, column: str | None = None, first: bool = False) -> Condition:
    """One word, or the run that a text with several makes; ``first``: at the start of the column."""
    words = _one_or_more(text)
    return _planned(_each(lambda t: _test(t, words, first=first), column), "run", words, False, first, column)


phrase = term


def prefix(text: str, column: str | None = None, first: bool = False) -> Condition:
    words = _one_or_more(text)
    return _planned(_each(lambda t: _test(t, words, True, first), column), "run", words, True, first, column)


def near(parts: list[str], distance: int = 10, column: str | None = None) -> Condition:
    """Words or phrases with at most ``distance`` other tokens between the first and the last of them."""
    runs = [_one_or_more(p) for p in parts]
    room = distance + sum(map(len, runs))
    # From the first token of a window, each part lies wholly within it.
    inside = "".join(f"(?=(?:[^ ]+ ){{0,{room - len(words)}}}{' '.join(words)} )" for words in runs)
    every = [" " + " ".join(words) + " " for words in runs]

    def test(tokens: Column) -> Column:
        return reduce(lambda a, b: a & b, [tokens.contains(w) for w in every]) & tokens.rlike(" " + inside)

    return _planned(_each(test, column), "near", runs, room, column)


def all_of(*parts: Condition) -> Condition:
    return _planned(lambda tokens: reduce(lambda a, b: a & b, [p(tokens) for p in parts]), "all", parts)


def any_of(*parts: Condition) -> Condition:
    return _planned(lambda tokens: reduce(lambda a, b: a | b, [p(tokens) for p in parts]), "any", parts)


def but_not(wanted: Condition, *parts: Condition) -> Condition:
    return _planned(lambda tokens: reduce(lambda a, b: a & ~b, [p(tokens) for p in parts], wanted(tokens)), "but_not", wanted, parts)


def tokens_of(columns: list[str], fold: bool = True) -> dict[str, Column]:
    return {c: X.token_text(X.fold_accents(F.col(c)) if fold else F.col(c)) for c in columns}


def matches(condition: Condition, columns: list[str], fold: bool = True) -> Column:
    """A condition as one predicate over text columns; ``fold`` reads letters without accents."""
    return condition(tokens_of(columns, fold))


def find(docs: DataFrame, ident: str, columns: list[str], condition: Condition, fold: bool = True) -> DataFrame:
    """Ids of the rows that a condition matches: one scan, no shuffle."""
    return docs.where(matches(condition, columns, fold)).select(F.col(ident).alias("id"))


def with_fallback(docs: DataFrame, ident: str, columns: list[str], text: str, fold: bool = True) -> DataFrame:
    """``id, match_mode``: rows that hold every word, or any of them if none holds all.

    A hyphen counts as a space.  One scan marks both; whether a row holds every word
    is told by one aggregate beside it.
    """
    words = words_of(text.replace("-", " "))
    if not words:
        raise QueryError("empty query")
    n = len(set(words))
    tokens = list(tokens_of(columns, fold).values())
    held = [reduce(lambda a, b: a | b, [F.coalesce(_test(t, [w]), F.lit(False)) for t in tokens]) for w in sorted(set(words))]
    seen = docs.select(F.col(ident).alias("id"), reduce(lambda a, b: a + b, [h.cast("int") for h in held]).alias("n")).where(F.col("n") > 0)
    if n < 2:
        return seen.select("id", F.lit("strict").alias("match_mode"))
    strict = F.col("n") == n
    none = seen.agg(F.coalesce(F.max("n"), F.lit(0)) < n).scalar()
    return seen.where(strict | none).select("id", F.when(strict, "strict").otherwise("any_term").alias("match_mode"))


# ---------------------------------------------------------------------- batches

#: Up to so many words of queries go to every task.
SMALL = 100_000


def postings(docs: DataFrame, id_col: str, text_col: str, fold: bool = False) -> DataFrame:
    """``id, term, pos``: every token with its place; texts without tokens give none."""
    text = X.fold_accents(F.col(text_col)) if fold else F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(X.tokens(text)).alias("pos", "term"))


def search_batch(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, need: str = "all", fold: bool = False) -> DataFrame:
    """Many bag-of-words queries at once: ``query_id, id, matched``.

    Only pairs of a document and a term that some query asks for are made, never one that
    carries the document's other terms.  With ``need`` ``all``, a document meets a query
    through the query's rarest term and the query's other terms are then looked up among
    the pairs: a common word is never joined with all its documents.  With ``any``, terms
    meet documents one by one.
    """
    text = X.fold_accents(F.col(text_col)) if fold else F.col(text_col)
    each = written(queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term")).distinct(), "asked")
    wanted = each.select("term").distinct()
    if each.count() <= SMALL:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(X.tokens(text))).alias("term")).join(wanted, "term", "left_semi")
    if need == "any":
        hits = each.join(rows, "term")
        return hits.groupBy("query_id", "id").agg(F.count_distinct("term").alias("matched"))
    pairs = written(rows, "pairs")
    often = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)), F.col("term"))
    rarest = each.join(often, "term", "left").groupBy("query_id").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("matched")).select("query_id", "matched", F.col("r.term").alias("term"))
    begun = rarest.join(pairs, "term").select("query_id", "id", "matched").distinct()
    # The pairs of documents that a query begins to match, each with the queries' other terms.
    sought = begun.join(each, "query_id")
    held = sought.join(pairs.join(begun.select("id").distinct(), "id", "left_semi").distinct(), ["id", "term"]).groupBy("query_id", "id", "matched").agg(F.count(F.lit(1)).alias("n"))
    return held.where("n = matched").select("query_id", "id", "matched")


# -------------------------------------------------------------- corpus retrieval

_DELETED = '"[]{}()*^:-+'


def corpus_words(text: str) -> list[str]:
    """Query words of the corpus plan: special characters deleted, not spaced."""
    return [w for w in (t.translate(str.maketrans("", "", _DELETED)) for t in text.lower().split()) if w]


def corpus_match(tokens: Column, words: list[str], every: bool = True) -> Column:
    """Units whose token text has tokens that begin with all (or any) of the words.

    A word that splits into several tokens matches as a run of them, the last one
    by its beginning.
    """
    tests = [_test(tokens, runs, prefix=True) for word in words if (runs := words_of(word))]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests, F.lit(every and bool(tests)))


def rank_corpus(units: DataFrame, query: str, limit: int = 10, semantic: Column | None = None) -> DataFrame:
    """Units found by prefix, ranked by whole-word counts, then by owner and place.

    Falls back to any word where no unit holds all of them.  The score of a
    semantic adapter, if any, is added to the lexical one.
    """
    words = corpus_words(query)
    if not words:
        return units.withColumn("score", F.lit(0.0)).limit(0)
    low = F.lower(F.col("text"))
    begins = [low.contains(runs[0].lower()) for w in words if (runs := _TOKEN.findall(w))]  # cheap, and true of every match
    some = begins[0] if begins else F.lit(False)
    for b in begins[1:]:
        some = some | b
    tokens = X.token_text(F.col("text"))
    found = units.where(some & corpus_match(tokens, words, every=False)).withColumn("every", corpus_match(tokens, words))
    score = X.lexical_score(F.col("text"), words)
    total = F.round(score + semantic, 6) if semantic is not None else F.round(score, 6)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = [F.desc("score"), blank("profile_id"), blank("project_id"), blank("source_ref"), "location_id", "line_no"]
    top = found.withColumn("score", total).orderBy(F.desc("every"), *order).limit(limit)
    # Units that hold every word come first, so the page tells whether there are any.
    best = top.withColumn("any_whole", F.max("every").over(Window.partitionBy(F.lit(1))))
    return best.where(F.col("every") | ~F.col("any_whole")).orderBy(*order)


# The fields that a corpus plan may filter by.
METADATA = ("profile_id", "project_id", "space_id", "source_ref", "kind", "lifecycle_status")


def retrieve_corpus(units: DataFrame, triples: list[tuple], text: str = "", metadata: dict | None = None, limit: int = 100, semantic: Column | None = None) -> DataFrame:
    """Scope, then closed filters, then match, score and rank: nothing outside the scope has a part in it.

    A field outside the closed set is an error; a limit outside 1 to 500 counts as
    100.  Without words every unit left is a hit with score 0.  A semantic score that
    is null for a unit leaves its lexical one.
    """
    from cairn.operators.access import corpus_scope

    if unknown := sorted(set(metadata or {}) - set(METADATA)):
        raise QueryError(f"unsupported_corpus_metadata_key: {unknown[0]!r}")
    if not isinstance(limit, int) or not 1 <= limit <= 500:
        limit = 100
    rows = units.withColumns({c: F.lit(None).cast("string") for c in METADATA if c not in units.columns}).where(corpus_scope(triples))
    for name, value in (metadata or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    extra = F.coalesce(semantic, F.lit(0.0)) if semantic is not None else None
    if corpus_words(text):
        return rank_corpus(rows, text, limit, extra)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    scored = rows.withColumn("score", F.round(extra, 6) if extra is not None else F.lit(0.0))
    return scored.orderBy(F.desc("score"), blank("profile_id"), blank("project_id"), blank("source_ref"), "location_id", "line_no").limit(limit)


def snippet(text: Column, terms: list[str], size: int = 8) -> Column:
    """A window of words around the first hit, hits in brackets."""
    words = F.split(X.collapse(text), " ")
    wanted = F.array(*map(F.lit, terms))
    hits = F.transform(words, lambda w: F.arrays_overlap(X.tokens(w), wanted))
    first = F.greatest(F.array_position(hits, F.lit(True)), F.lit(1)).cast("int")
    start = F.greatest(F.lit(1), first - size // 2)
    mark = lambda w, h: F.when(h, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)
    shown = F.zip_with(F.slice(words, start, F.lit(size)), F.slice(hits, start, F.lit(size)), mark)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(start + size - 1 < F.size(words), "...").otherwise(""))
