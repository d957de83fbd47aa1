"""From aligned rows to pairs with ids, language rows, and the relational store."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.lexicons import LANGUAGES
from lexiloom.plans.staging import cut

#: Bits of monotonically_increasing_id that count the rows of a partition; those above are the partition's number.
PLACE_BITS = 33
#: Fixed values of search documents.
BOOK_ID, BOOK_TITLE = 1, "Thirty-six reasons for winning the lost"

MODES = ("relational", "search", "pipeline")


def clean_rows(rows: DataFrame, mode: str = "relational", en: str = "en", fr: str = "fr") -> DataFrame:
    """The rows that an ingest path keeps, as text_en and text_fr beside the other columns.

    relational: both sides trimmed, kept where neither is empty. search: trimmed, all kept. pipeline: untrimmed, kept where
    English isn't blank. A null text is empty. An unknown mode is a ValueError."""
    a, b = F.coalesce(F.col(en), F.lit("")), F.coalesce(F.col(fr), F.lit(""))
    if mode == "pipeline":
        out = rows.withColumns({"text_en": a, "text_fr": b}).where(~F.col("text_en").rlike(r"^\s*$"))
    elif mode in MODES:
        out = rows.withColumns({"text_en": T.trim(a), "text_fr": T.trim(b)})
        if mode == "relational":
            out = out.where((F.col("text_en") != "") & (F.col("text_fr") != ""))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.drop(*({en, fr} - {"text_en", "text_fr"}))


def number_rows(df: DataFrame, order: str, ties: list[str], name: str = "pair_id") -> DataFrame:
    """Consecutive numbers from 1 in the order of a column, without one task for all rows. Nulls come first.

    Rows are dealt out by ranges of the order, whatever its values (dense, sparse, null or one value over and over, since ties
    and then the place in the input part equal ones), sorted within a range and numbered there; the ranges' sizes, one row for
    each, give the offsets."""
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(order).asc_nulls_first(), *(F.col(t).asc_nulls_first() for t in ties), F.col("input_")]
    spread = df.withColumn("input_", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = cut(spread.drop("input_").withColumn("place_", F.monotonically_increasing_id()))
    part = F.shiftright("place_", PLACE_BITS).alias("range_")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("size_"))
    starts = sizes.select("range_", (F.sum("size_").over(Window.orderBy("range_")) - F.col("size_")).alias("start_"))
    number = F.col("start_") + F.col("place_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return placed.withColumn("range_", part).join(F.broadcast(starts), "range_").withColumn(name, number).drop("range_", "place_", "start_")


def pairs(rows: DataFrame, order: str = "row_id", mode: str = "relational") -> DataFrame:
    """Pair documents: (pair_id, book_id, book_title, position, segment_id_en, segment_id_fr, text_en, text_fr, doc_id).

    pair_id and position count the kept rows from 1 in the order of `order`; segment ids are 2n - 1 and 2n; doc_id is `pair-n`."""
    kept = clean_rows(rows, mode).select(order, "text_en", "text_fr")
    n = F.col("pair_id")
    return number_rows(kept, order, ["text_en", "text_fr"]).select(
        n,
        F.lit(BOOK_ID).cast("bigint").alias("book_id"),
        F.lit(BOOK_TITLE).alias("book_title"),
        n.alias("position"),
        (2 * n - 1).alias("segment_id_en"),
        (2 * n).alias("segment_id_fr"),
        "text_en",
        "text_fr",
        F.concat(F.lit("pair-"), n.cast("string")).alias("doc_id"),
    )


def by_language(docs: DataFrame) -> DataFrame:
    """Each pair once for either language as source: (lang, pair_id, position, book_id, book_title, segment_id, alignment_id, text, alignment_text, alignment_lang)."""

    def one(a: str, b: str):
        return F.struct(F.lit(a).alias("lang"), F.col(f"segment_id_{a}").alias("segment_id"), F.col(f"segment_id_{b}").alias("alignment_id"), F.col(f"text_{a}").alias("text"), F.col(f"text_{b}").alias("alignment_text"), F.lit(b).alias("alignment_lang"))

    en, fr = LANGUAGES
    return docs.select("pair_id", "position", "book_id", "book_title", F.inline(F.array(one(en, fr), one(fr, en))))


def store(docs: DataFrame, title: str, author: str | None = None, year: int | None = None, first_book: int = 1, first_segment: int = 1, source: str = "CSV import") -> dict[str, DataFrame]:
    """The relational store's new rows: books, segments and alignments of one import.

    Two books, `title (EN)` and `title (FR)`; segments numbered from first_segment, English before French within a pair;
    an alignment for each pair, confidence 1.0."""
    spark = docs.sparkSession
    books = spark.createDataFrame(
        [(first_book, f"{title} (EN)", author, year, "en", source), (first_book + 1, f"{title} (FR)", author, year, "fr", source)],
        "id bigint, title string, author string, year int, language string, source string",
    )
    base = first_segment - 1
    sides = F.inline(F.array(*(F.struct((F.col(f"segment_id_{x}") + base).alias("id"), F.lit(first_book + k).cast("bigint").alias("book_id"), F.col("position").cast("int").alias("position"), F.lit(x).alias("language"), F.col(f"text_{x}").alias("text")) for k, x in enumerate(LANGUAGES))))
    alignments = docs.select(F.col("pair_id").alias("id"), (F.col("segment_id_fr") + base).alias("segment_fr_id"), (F.col("segment_id_en") + base).alias("segment_en_id"), F.lit(1.0).alias("confidence"))
    return {"books": books, "segments": docs.select(sides), "alignments": alignments}


def stored_pairs(alignments: DataFrame, segments: DataFrame) -> DataFrame:
    """(pair_id, text_en, text_fr) of stored alignments both of whose segments exist; a segment delivered again is one segment.

    An alignment with a null id on a side has no pair; repeated alignments stay repeated, as each is a row of the store."""
    once = segments.where("id is not null and text is not null").groupBy("id").agg(F.max_by("text", F.struct("loaded_at", "text")).alias("text")) if "loaded_at" in segments.columns else segments.where("id is not null and text is not null").dropDuplicates(["id"]).select("id", "text")
    side = lambda x: once.select(F.col("id").alias(f"segment_{x}_id"), F.col("text").alias(f"text_{x}"))
    return alignments.select(F.col("id").alias("pair_id"), "segment_en_id", "segment_fr_id").join(side("en"), "segment_en_id").join(side("fr"), "segment_fr_id").select("pair_id", "text_en", "text_fr")
