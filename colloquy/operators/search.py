"""Full-text search on an inverted-index table.

A search is a list of terms split at white space.  A term is a phrase of adjacent
words whose last word is a prefix; all terms must hit the title or the body.  The
index has one row per (token, column, conversation) with the word positions; it is
range-partitioned and sorted by token, so a prefix read touches few row groups and
a frequent token is spread over several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schemas as S
from colloquy.functions import fold
from colloquy.functions.text import WS, let, trim_ws


def _places(words: Column) -> Column:
    """``(token, positions)`` of each different word of a list."""

    def runs(placed: Column) -> Column:
        starts = F.filter(
            F.transform(placed, lambda p, i: F.when((i == 0) | (p["token"] != F.get(placed, i - 1)["token"]), i)),
            lambda i: i.isNotNull(),
        )

        def run(bounds: Column) -> Column:
            return F.transform(bounds, lambda at, k: F.struct(
                F.get(placed, at)["token"].alias("token"),
                F.transform(
                    F.slice(placed, at + 1, F.coalesce(F.get(bounds, k + 1), F.size(placed)) - at), lambda p: p["position"]
                ).alias("positions"),
            ))

        return let(starts, run)

    placed = F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("position")))
    return let(F.array_sort(placed), runs)


def postings(documents: DataFrame) -> DataFrame:
    """A conversation is one row, so its postings are made in place, without a shuffle of its words."""
    columns = F.array(
        F.struct(F.lit("title").alias("column"), _places(fold.tokens(F.col("title"))).alias("places")),
        F.struct(F.lit("body").alias("column"), _places(fold.tokens(F.col("body"))).alias("places")),
    )
    return documents.select("conversation_key", F.inline(columns)).select(
        "conversation_key", "column", F.inline("places")
    ).select("token", "column", "conversation_key", "positions")


def write_postings(index: DataFrame, path: str) -> None:
    """Sorted by token inside each file; a hot token may span several files."""
    (
        index.repartitionByRange("token", "conversation_key")
        .sortWithinPartitions("token", "conversation_key")
        .write.mode("overwrite")
        .parquet(path)
    )


def search_terms(searches: DataFrame) -> DataFrame:
    """``(query_id, search)`` to one row per term: its number, its words, the term count.

    An empty search has no terms and so no row; every term counts.
    """
    trimmed = trim_ws(F.col("search"))
    terms = F.split(trimmed, f"[{WS}]+")
    rows = searches.where(trimmed != "").select("query_id", F.posexplode(terms).alias("term_no", "term"))
    return rows.select("query_id", "term_no", "term", fold.tokens(F.col("term")).alias("words"))


def term_words(terms: DataFrame) -> DataFrame:
    """One row per word of a term; the last word of a term is a prefix."""
    return terms.select(
        "query_id", "term_no", F.size("words").alias("n_words"), F.posexplode("words").alias("word_no", "word")
    ).withColumn("is_prefix", F.col("word_no") == F.col("n_words") - 1)


def word_hits(words: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows that a word of a search matches, by equi-joins only.

    The vocabulary (one row per distinct token) is matched first: a token is offered
    under each of its prefixes whose length some search uses.  The matched tokens
    then select index rows.
    """
    wanted = words.select("word", "is_prefix").distinct()
    exact = wanted.where(~F.col("is_prefix")).select("word", "is_prefix", F.col("word").alias("token"))
    lengths = wanted.where("is_prefix").select(F.length("word").alias("len")).distinct()
    # The lengths of words in use: a few numbers for each search.
    used = [row.len for row in lengths.collect()]
    cuts = F.array(*[F.when(F.length("token") >= n, F.left("token", F.lit(n))) for n in sorted(used)])
    vocabulary = index.select("token").distinct()
    offered = vocabulary.select("token", F.explode(F.array_compact(cuts)).alias("word")) if used else None
    matched = exact
    if offered is not None:
        matched = matched.unionByName(
            wanted.where("is_prefix").join(offered, "word").select("word", "is_prefix", "token")
        )
    chosen = words.join(matched, ["word", "is_prefix"])
    return chosen.join(index, "token").select(
        "query_id", "term_no", "word_no", "n_words", "column", "conversation_key", "positions"
    )


def term_places(words: DataFrame, index: DataFrame) -> DataFrame:
    """``(query_id, term_no, conversation_key, column, starts)`` of each term found.

    A word of its own starts at all its positions, row by row; such a term may have several
    rows of a conversation, one for each token.  A phrase of n words starts where its n
    words line up: a position holds one token, so a start comes from each word at most once.
    Only the rows of phrases meet, as position lists by conversation.
    """
    keys = ["query_id", "term_no", "conversation_key", "column"]
    hits = word_hits(words, index)
    single = hits.where("n_words = 1").select(*keys, F.col("positions").alias("starts"))
    shifted = F.transform("positions", lambda p: p - F.col("word_no"))
    found = (
        hits.where("n_words > 1")
        .select(*keys, "n_words", "word_no", shifted.alias("shifted"))
        .groupBy(*keys, "n_words")
        .agg(F.array_sort(F.flatten(F.collect_list("shifted"))).alias("all"))
    )
    lined_up = F.filter("all", lambda v, i: F.coalesce(F.get("all", i + F.col("n_words") - 1) == v, F.lit(False)))
    phrases = found.select(*keys, lined_up.alias("starts")).where(F.size("starts") > 0)
    return single.unionByName(phrases)


def term_hits(words: DataFrame, index: DataFrame) -> DataFrame:
    """``(query_id, term_no, conversation_key, column, start)`` of each term found."""
    return term_places(words, index).select(
        "query_id", "term_no", "conversation_key", "column", F.explode("starts").alias("start")
    )


def matches(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``(query_id, conversation_key)`` where every term of the search hits.

    A term without any word (punctuation only) matches nothing.
    """
    needed = terms.groupBy("query_id").agg(F.count("*").alias("needed"))
    found = (
        term_places(term_words(terms), index)
        .groupBy("query_id", "conversation_key")
        .agg(F.size(F.collect_set("term_no")).alias("found"))
    )
    return (
        found.join(needed, "query_id")
        .where(F.col("found") == F.col("needed"))
        .select("query_id", "conversation_key")
    )


def phrase_filter(index: DataFrame, words: list[str]) -> DataFrame:
    """Rows whose token starts with one of the words; the prefix test reaches the scan."""
    test = F.lit(False)
    for word in words:
        test = test | F.col("token").startswith(word)
    return index.where(test)


def one_search(index: DataFrame, terms: list[list[str]]) -> DataFrame:
    """Conversations that one search hits, its terms being known as lists of words.

    Terms of one word need no positions: a single pass over the pushed-down prefixes
    marks the terms that each row satisfies.
    """
    if any(not words for words in terms):
        return index.select("conversation_key").where(F.lit(False))
    rows = phrase_filter(index, sorted({w for words in terms for w in words}))
    if all(len(words) == 1 for words in terms):
        asked = sorted({words[0] for words in terms})
        flags = [F.bool_or(F.col("token").startswith(word)).alias(f"f{i}") for i, word in enumerate(asked)]
        found = rows.groupBy("conversation_key").agg(*flags)
        for i in range(len(asked)):
            found = found.where(F.col(f"f{i}"))
        return found.select("conversation_key")
    asked = index.sparkSession.createDataFrame(
        [("q", i, words) for i, words in enumerate(terms)], "query_id string, term_no int, words array<string>"
    )
    return matches(asked, rows).select("conversation_key")


def term_starts(words: Column, terms: list[list[str]]) -> Column:
    """``(start, term_no)`` of every place where a term is found in a list of words."""

    def at(i: Column) -> Column:
        hits = []
        for number, term in enumerate(terms):
            test = F.coalesce(F.get(words, i + (len(term) - 1)).startswith(term[-1]), F.lit(False))
            for k, word in enumerate(term[:-1]):
                test = test & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            hits.append(F.when(test, F.struct(i.alias("start"), F.lit(number).alias("term_no"))))
        return F.array_compact(F.array(*hits))

    return F.flatten(F.transform(words, lambda w, i: at(i)))


def with_preview(page: DataFrame, documents: DataFrame, terms: list[list[str]]) -> DataFrame:
    """Adds the preview to the rows of one page.

    The hits are found again in the bodies of the page; adaptive execution broadcasts a
    page that is small.
    """
    bodies = documents.select("conversation_key", "body").join(page, "conversation_key")
    # Bound once: a position looks into the words, and must not make them anew.
    starts = let(fold.tokens(F.col("body")), lambda words: term_starts(words, terms))
    preview = let(starts, lambda found: snippet(F.col("body"), found))
    return bodies.withColumn("match_preview", preview).drop("body")


def snippet(body: Column, starts: Column) -> Column:
    """Eighteen words of the body around the hits.

    ``starts`` holds ``(start, term_no)`` structs of the body hits, in order.  The window
    that covers the most different terms wins, the earliest one on a tie; without a body
    hit it is the first words.  A window holds at most 18 words, each with a hit of
    every term at most, so each start looks at so many hits after it.
    """
    width = S.SNIPPET_TOKENS
    reach = F.size(F.array_distinct(F.transform(starts, lambda h: h["term_no"]))) * width

    def terms_in(hits: Column) -> Column:
        return F.size(F.array_distinct(F.transform(hits, lambda h: h["term_no"])))

    def render(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(n - width, F.lit(0))

        def score(hit: Column, i: Column) -> Column:
            near = F.slice(starts, i + 1, reach)
            inside = F.filter(near, lambda h: h["start"] < hit["start"] + width)
            return F.struct(terms_in(inside).alias("terms"), (-hit["start"]).alias("back"))

        # The windows of hits near the end all coincide with the last window.
        head = F.transform(F.filter(starts, lambda h: h["start"] <= last), score)
        tail = F.filter(starts, lambda h: h["start"] >= last)
        tail_score = F.array(F.struct(terms_in(tail).alias("terms"), (-last).alias("back")))
        best = F.array_max(F.concat(head, F.when(F.size(tail) > 0, tail_score).otherwise(F.slice(tail_score, 1, 0))))
        at = F.coalesce(-best["back"], F.lit(0))
        shown = F.regexp_replace(F.array_join(F.slice(words, at + 1, F.lit(width)), ""), r"[^\p{L}\p{N}]+\z", "")
        return F.concat(
            F.when(at > 0, F.lit("… ")).otherwise(F.lit("")),
            shown,
            F.when(at + width < n, F.lit(" …")).otherwise(F.lit("")),
        )

    return let(fold.pieces(body), render)


def snippets(hits: DataFrame, places: DataFrame, documents: DataFrame) -> DataFrame:
    """``(query_id, conversation_key, match_preview)`` for matched conversations, from their ``term_places``."""
    named = F.transform("starts", lambda start: F.struct(start.alias("start"), F.col("term_no").alias("term_no")))
    body_starts = (
        places.where(F.col("column") == "body")
        .join(hits, ["query_id", "conversation_key"], "left_semi")
        .select("query_id", "conversation_key", named.alias("starts"))
        .groupBy("query_id", "conversation_key")
        .agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))
    )
    empty = F.array().cast("array<struct<start: int, term_no: int>>")
    return (
        hits.join(body_starts, ["query_id", "conversation_key"], "left")
        .join(documents.select("conversation_key", "body"), "conversation_key")
        .select(
            "query_id",
            "conversation_key",
            snippet(F.col("body"), F.coalesce("starts", empty)).alias("match_preview"),
        )
    )
