"""Reading aligned CSV files and writing the engine's tables."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import ingest, lexicon
from lexiloom.plans.staging import cut


def read_aligned_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, en, fr) of a UTF-8 CSV with a header that names the columns; quoted fields may hold commas, quotes and line ends.

    A missing file is a FileNotFoundError. An empty or missing field is null. row_id is in the order of the file and,
    with several files, of their names."""
    try:
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    missing = {"en", "fr"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
    return raw.select(F.monotonically_increasing_id().alias("row_id"), "en", "fr")


def import_csv(spark: SparkSession, path: str, mode: str = "relational") -> DataFrame:
    """Pair documents of an aligned CSV; a ValueError if no row is kept."""
    docs = ingest.pairs(read_aligned_csv(spark, path), mode=mode)
    if docs.isEmpty():
        raise ValueError(f"no aligned pair in {path}")
    return docs


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def locked(spark: SparkSession, folder: str):
    """Only one writer at a time in a folder: a lock file, made by the folder's file system only where there is none."""
    fs, path = _file_system(spark, folder)
    fs.mkdirs(path)
    lock = spark._jvm.org.apache.hadoop.fs.Path(path, "_lock")
    if not fs.createNewFile(lock):
        raise RuntimeError(f"{folder} is being written; remove {folder}/_lock if no writer is left")
    try:
        yield
    finally:
        fs.delete(lock, False)


def replace_table(df: DataFrame, folder: str) -> None:
    """Write df beside the folder and put it in its place, so that a failure on the way leaves the old table. df may read the folder."""
    spark = df.sparkSession
    fs, path = _file_system(spark, folder)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}__new")
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(path, True)
    if not fs.rename(new, path):
        raise RuntimeError(f"could not rename {new.toString()} to {folder}")


def existing(spark: SparkSession, folder: str) -> DataFrame | None:
    """The Parquet table in a folder; None only where there is no such folder. Any other fault is raised."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_store(docs: DataFrame, folder: str, title: str, author: str | None = None, year: int | None = None, source: str = "CSV import") -> tuple[int, int]:
    """Append one import to the relational store in a folder: books, segments, alignments; the two new books' ids are returned.

    New ids follow the largest there. One import at a time (`locked`), so ids never collide. Books come last: segments of an import
    that broke off belong to no book, and the ids after them are used next."""
    spark = docs.sparkSession

    def following(name: str) -> int:
        there = existing(spark, f"{folder}/{name}")
        return 1 if there is None else (there.agg(F.max("id")).first()[0] or 0) + 1

    with locked(spark, folder):
        first, start = following("books"), following("alignments") - 1
        tables = ingest.store(docs, title, author, year, first, following("segments"), source)
        tables["alignments"] = tables["alignments"].withColumn("id", F.col("id") + start)
        for name in ("segments", "alignments", "books"):
            tables[name].write.mode("append").parquet(f"{folder}/{name}")
    return first, first + 1


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs (pair_id, text_en, text_fr) of the store's alignments."""
    return ingest.stored_pairs(spark.read.parquet(f"{folder}/alignments"), spark.read.parquet(f"{folder}/segments"))


def write_lexicon(docs: DataFrame, folder: str) -> int:
    """Write word_translations and stem_forms anew; the number of lexicon entries is returned."""
    replace_table(lexicon.lexicon(docs), f"{folder}/word_translations")
    replace_table(lexicon.stem_forms(docs), f"{folder}/stem_forms")
    return docs.sparkSession.read.parquet(f"{folder}/word_translations").count()


def write_documents(docs: DataFrame, folder: str, keep: bool = False, shown: int = 5) -> tuple[int, list[dict]]:
    """Write pair documents, one for each doc_id, and return the number written and the first `shown` errors.

    Without keep the index starts anew; with it, documents there stay unless their id comes again (upsert). Of several rows
    with one id the last by pair_id, then by text, holds. Rows without an id or a text are errors: they go to
    `rejected` with a reason. Every row is judged once, in one pass that writes both parts."""
    spark = docs.sparkSession
    reason = F.when(F.col("doc_id").isNull(), "no doc_id").when(F.col("text_en").isNull() | F.col("text_fr").isNull(), "no text")
    tagged = cut(docs.withColumn("reason", reason))
    columns = [c for c in docs.columns if c != "doc_id"]
    with locked(spark, folder):
        new = tagged.where("reason is null").groupBy("doc_id").agg(F.max(F.struct(*columns)).alias("d")).select("doc_id", "d.*")
        old = existing(spark, f"{folder}/documents") if keep else None
        whole = new if old is None else cut(new.unionByName(old.join(new.select("doc_id"), "doc_id", "left_anti")))
        replace_table(whole, f"{folder}/documents")
        replace_table(tagged.where("reason is not null"), f"{folder}/rejected")
    rejected = spark.read.parquet(f"{folder}/rejected")
    errors = rejected.orderBy(F.col("pair_id").asc_nulls_first(), "reason").limit(shown).select("doc_id", "pair_id", "reason").collect() if "pair_id" in docs.columns else rejected.limit(shown).select("doc_id", "reason").collect()
    return tagged.where("reason is null").count(), [r.asDict() for r in errors]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The pair documents of an index folder."""
    return spark.read.parquet(f"{folder}/documents")


def write_json(responses: DataFrame, folder: str) -> None:
    """One JSON object a line."""
    responses.select(F.col("response").alias("value")).write.mode("overwrite").text(folder)
