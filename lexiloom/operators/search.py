"""The search as one plan over a table of queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.lexicons import LANGUAGES
from lexiloom.operators import highlight, ingest, lexicon, retrieval
from lexiloom.plans.skew import SMALL_ROWS
from lexiloom.plans.staging import cut

DEFAULT_LANG, DEFAULT_LIMIT = "en", 20
#: Columns of a result.
RESULT = "query_id int, query string, lang string, rank int, segment_id bigint, book_id bigint, book_title string, language string, text string, text_highlighted string, alignment_text string, alignment_language string, alignment_id bigint, alignment_highlights array<string>"


def checked(queries: DataFrame, on_error: str = "raise") -> DataFrame:
    """(query_id, q, lang, limit) with q trimmed and defaults filled in.

    A null or empty q, an unknown language or a negative limit is an error: with on_error="raise" the plan fails on such a
    row, with "empty" the row is left out, so it has no hits."""
    if on_error not in ("raise", "empty"):
        raise ValueError("on_error is 'raise' or 'empty'")
    filled = queries.select("query_id", F.col("q").cast("string").alias("q"), F.coalesce("lang", F.lit(DEFAULT_LANG)).alias("lang"), F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"))
    good = F.coalesce((F.length("q") >= 1) & F.col("lang").isin(*LANGUAGES) & (F.col("limit") >= 0), F.lit(False))
    if on_error == "raise":
        filled = filled.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("invalid query "), F.coalesce(F.col("query_id").cast("string"), F.lit("null"))))))
    else:
        filled = filled.where(good)
    return filled.withColumn("q", T.trim(F.col("q")))


def hits(queries: DataFrame, index: retrieval.Index) -> DataFrame:
    """Each query's ranked pairs with texts and ids, and text_highlighted: the text with matched words marked."""
    asked = cut(retrieval.query_terms(queries))
    best = cut(retrieval.ranked(queries, index, asked))
    few = F.broadcast(best) if best.count() <= SMALL_ROWS else best
    terms = retrieval.matched_terms(asked, index.stats)
    found = index.rows.drop("position").join(few, ["lang", "pair_id"]).join(queries.select("query_id", "q"), "query_id").join(terms, "query_id", "left")
    return cut(found.withColumn("text_highlighted", retrieval.marked(F.col("text"), F.col("lang"), F.coalesce("terms", F.array().cast("array<string>")))).drop("terms"))


def search(queries: DataFrame, docs: DataFrame, entries: DataFrame | None = None, forms: DataFrame | None = None, on_error: str = "raise") -> DataFrame:
    """Results of a table of queries, a row for each hit:
    (query_id, query, lang, rank, segment_id, book_id, book_title, language, text, text_highlighted, alignment_text,
    alignment_language, alignment_id, alignment_highlights).

    entries and forms are the lexicon and its stem forms; without them both are derived from docs, for the words asked. An
    empty aligned text is null. With an index of docs at hand, `results` saves building it."""
    asked = checked(queries, on_error)
    hints = lexicon.corpus_hints(asked, cut(lexicon.stems(docs))) if entries is None or forms is None else lexicon.hints(asked, entries, forms)
    return results(asked, retrieval.build(ingest.by_language(docs)), hints)


def search_or_empty(queries: DataFrame, docs: DataFrame, *args) -> DataFrame:
    """`search` run at once, with an empty result instead of an error, whatever fails (a missing file, a lost table, a bad query)."""
    try:
        return cut(search(queries, docs, *args, on_error="empty"))
    except Exception:  # noqa: BLE001  the caller asked for an empty answer
        return queries.sparkSession.createDataFrame([], RESULT)


def results(asked: DataFrame, index: retrieval.Index, hints: DataFrame) -> DataFrame:
    """The same from checked queries, an index and hints (query_id, word_idx, rank, surface)."""
    found = hits(asked, index).join(lexicon.hint_lists(hints), "query_id", "left")
    return highlight.highlights(found).select(
        "query_id", F.col("q").alias("query"), "lang", "rank", "segment_id", "book_id", F.coalesce("book_title", F.lit("")).alias("book_title"), F.col("lang").alias("language"), "text", "text_highlighted",
        F.nullif("alignment_text", F.lit("")).alias("alignment_text"), F.col("alignment_lang").alias("alignment_language"), "alignment_id", "alignment_highlights",
    )


def responses(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, response): the JSON object of each query, {query, lang, count, results}; queries without hits count 0."""
    item = F.struct("segment_id", "book_id", "book_title", "language", "text", "text_highlighted", "alignment_text", "alignment_language", "alignment_id", "alignment_highlights")
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item")))).alias("ranked"))
    listed = queries.select("query_id", "q", "lang").join(lists, "query_id", "left").withColumn("results", F.coalesce(F.transform("ranked", lambda x: x["item"]), F.array().cast("array<struct<segment_id:bigint,book_id:bigint,book_title:string,language:string,text:string,text_highlighted:string,alignment_text:string,alignment_language:string,alignment_id:bigint,alignment_highlights:array<string>>>")))
    return listed.select("query_id", F.to_json(F.struct(T.trim(F.col("q")).alias("query"), "lang", F.size("results").alias("count"), "results"), {"ignoreNullFields": "false"}).alias("response"))
