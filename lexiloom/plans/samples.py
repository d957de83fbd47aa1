"""Query tables used by the catalogue's retrieval queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (query_id, q, lang, limit): single words, phrases, misspellings, both languages, a whole field, and one without hits.
QUERIES = [
    (1, "light", "en", 20),
    (2, "shepherd carried", "en", 20),
    (3, "the golden river", "en", 10),
    (4, "sheperd", "en", 10),
    (5, "wisdom", "en", 5),
    (6, "neither the widow nor the elder", "en", 20),
    (7, "old letter", "en", 20),
    (8, "xyzzyq", "en", 20),
    (9, "lumière", "fr", 20),
    (10, "berger porta", "fr", 20),
    (11, "l'église", "fr", 10),
    (12, "professuer", "fr", 10),
    (13, "la maison étroite", "fr", 20),
    (14, "petit", "fr", 5),
    (15, "the shepherd brought the flock", "en", 20),
    (16, "good", "en", 20),
]


def sample_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, q string, lang string, limit int")


def sample_sql() -> str:
    rows = ", ".join("({}, '{}', '{}', {})".format(i, q.replace("'", "''"), lang, n) for i, q, lang, n in QUERIES)
    return f'(select * from (values {rows}) v(query_id, q, lang, "limit"))'


#: Rows whose id is divisible by this are queries of row_queries; so many hits are wanted of each.
EVERY, ROW_LIMIT = 100, 10


def row_queries(rows: DataFrame) -> DataFrame:
    """The English text of every kept row (row_id, text_en) whose id is divisible by EVERY, as a query against all rows."""
    return rows.where(f"row_id % {EVERY} = 0").groupBy(F.col("row_id").cast("int").alias("query_id")).agg(F.min("text_en").alias("q")).select("query_id", "q", F.lit("en").alias("lang"), F.lit(ROW_LIMIT).alias("limit"))


def row_sql(kept: str) -> str:
    return f"""(select row_id::int as query_id, min(text_en) as q, 'en' as lang, {ROW_LIMIT} as "limit" from {kept} where row_id % {EVERY} = 0 group by row_id)"""
