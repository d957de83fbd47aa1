"""Mixing sources to target shares of the total size in tokens, by weighted sampling without replacement.

Every document draws an exponential key scaled by its quality weight (Efraimidis and Spirakis); within a source, documents
in the order of their keys are summed up to the source's budget. Complete epochs come first, the sampled part is what is
left of the budget. No source is ever sorted or windowed as a whole: sums by key bucket tell in which bucket the budget
ends; only that bucket's documents are ordered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.encoding import count_tokens
from lexiloom.llm.vocab import TOKENIZER_DIR
from lexiloom.plans.staging import cut

#: Key buckets of a source.
BUCKETS = 1 << 16
#: Rows of mix_targets up to which the cuts (one row each) are broadcast.
BROADCAST_TARGETS = 10_000


def quality_weight() -> Column:
    """Share of letters among a text's signs, at least 0.05."""
    return F.greatest(F.lit(0.05), F.col("n_letters") / F.greatest(F.col("n_chars"), F.lit(1)))


def measured(df: DataFrame, tokenizer: str, seed: int, id_col: str, text_col: str, source_col: str, tokenizer_dir: str) -> DataFrame:
    """(id_, source, n_tokens, weight, key in [0, 1)) of the documents that have a source and a token; small keys are drawn first."""
    packed = df.where(F.col(source_col).isNotNull() & (F.length(F.col(text_col)) > 0)).select(F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")).alias("doc"), F.col(text_col).alias("text"))
    sized = count_tokens(packed, tokenizer, "doc", "text", tokenizer_dir)
    u = (F.pmod(F.xxhash64(F.col("doc.id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = 1 - F.pow(u, 1 / F.col("weight"))  # one minus exp(-E / weight), E exponential: uniform in rank, whatever the weights
    return sized.withColumn("weight", quality_weight()).select(F.col("doc.id").alias("id_"), F.col("doc.source").alias("source"), "n_tokens", "weight", key.alias("key"))


def budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row for each (mix_id, source) of targets: (mix_id, source, target_share, max_repeats, n_docs, available, share, budget, epochs, rest)."""
    wanted = (
        targets.where("mix_id is not null and source is not null")
        .groupBy("mix_id", "source")
        .agg(F.max("target_share").alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
        .withColumn("target_share", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)))
    )
    there = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available"))
    mix = Window.partitionBy("mix_id")
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    total = F.lit(float(total_tokens)) if total_tokens else F.min(F.when(usable, F.col("available") * F.col("max_repeats") / F.col("share"))).over(mix)
    return (
        wanted.join(there, "source", "left")
        .fillna(0, ["n_docs", "available"])
        .withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(mix)).otherwise(F.lit(0.0)))
        .withColumn("total", total)
        .withColumn("budget", F.least(F.coalesce(F.round(F.col("total") * F.col("share")), F.lit(0.0)), (F.col("available") * F.col("max_repeats")).cast("double")).cast("bigint"))
        .withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
        .drop("total")
    )


def _prefix(docs: DataFrame, left: DataFrame, near) -> tuple[DataFrame, DataFrame]:
    """Take documents in the order of their keys while their sum stays within what is left of each (mix_id, source).

    Returns the documents with taken and left (what is left in the end), and the new left. Only the bucket in which the
    sum passes the budget is ordered; sums by bucket tell which one."""
    group = [c for c in ("mix_id", "source") if c in docs.columns]
    sums = docs.groupBy(*group, "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    over = sums.join(near(left), group).withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy("mix_id", "source").agg(F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"))).alias("at"))
    cuts = cut(left.join(over, ["mix_id", "source"], "left").select("mix_id", "source", "epochs", "left", F.col("at.bucket").alias("cut_bucket"), F.col("at.rest").alias("rest")))
    placed = docs.join(near(cuts.drop("epochs", "left")), group)
    order = Window.partitionBy("mix_id", "source").orderBy("key", "id_", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("bucket = cut_bucket").withColumn("taken", F.sum("n_tokens").over(order) <= F.col("rest"))
    clear = placed.where("cut_bucket is null or bucket <> cut_bucket").withColumn("taken", F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")))
    marked = cut(clear.unionByName(edge).select("mix_id", "source", "id_", "n_tokens", "key", "bucket", "taken"))
    got = marked.where("taken").groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("got"))
    remaining = cut(left.join(got, ["mix_id", "source"], "left").select("mix_id", "source", "epochs", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left")))
    return marked.join(near(remaining.drop("epochs")), ["mix_id", "source"]), remaining


def mix_sources(df: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", total_tokens: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer_dir: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """The mixes and their report.

    First: (mix_id, source, id_col, copies, n_tokens), a row for each document taken, copies at most the source's
    max_repeats. Second: (mix_id, source, target_share, share, max_repeats, n_docs, available_tokens, taken_tokens,
    n_taken, epochs, actual_share), a row for each source of each mix.

    Shares are taken relative to their sum over the mix's sources that have tokens. The total is total_tokens, or, without
    it, the largest size at which every such source can give its share within max_repeats; with it, a source that can't is
    given whole, max_repeats times. Where the sorted prefix ends short of the budget, the one
    further document whose size is nearest to what is missing is added. Sources without
    documents, with a share of null, 0 or less, or with max_repeats below 1 give nothing; a null max_repeats is 1. Of
    contradicting rows of targets the larger share and the smaller cap hold. Documents with null source, null or empty text
    are never taken. Rows of df repeated with the same id count as one document for each copy; equal keys are ordered by id. Other columns are not read."""
    docs = cut(measured(df, tokenizer, seed, id_col, text_col, source_col, tokenizer_dir))
    plan = cut(budgets(docs, targets, total_tokens))
    small = plan.count() <= BROADCAST_TARGETS
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    bucket = F.least(F.floor(F.col("key") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    docs = docs.withColumn("bucket", bucket)
    # the budget's rest is filled in two prefixes, the second over the documents that fit into what the first leaves, and
    # topped up by the one document that comes nearest to what is missing then
    first, left = _prefix(docs, plan.where("budget > 0").select("mix_id", "source", "epochs", F.col("rest").alias("left")), near)
    second, left = _prefix(first.where("not taken").where("n_tokens <= left").drop("taken", "left"), left, near)
    nearest = second.where("not taken and n_tokens < 2 * left").groupBy("mix_id", "source").agg(F.min(F.struct(F.abs(F.col("n_tokens") - F.col("left")).alias("miss"), "key", "id_", "n_tokens")).alias("x"))
    sampled = first.where("taken").select("mix_id", "source", "id_", "n_tokens").unionByName(second.where("taken").select("mix_id", "source", "id_", "n_tokens")).unionByName(nearest.select("mix_id", "source", "x.id_", "x.n_tokens"))
    whole_epochs = docs.join(near(plan.where("epochs > 0").select("mix_id", "source", "epochs")), "source").select("mix_id", "source", "id_", "n_tokens", F.col("epochs").alias("copies"))
    both = sampled.withColumn("copies", F.lit(1)).unionByName(whole_epochs)
    taken = both.groupBy("mix_id", "source", F.col("id_").alias(id_col), "n_tokens").agg(F.sum("copies").alias("copies")).select("mix_id", "source", id_col, "copies", "n_tokens")
    got = taken.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("taken_tokens"), F.count(F.lit(1)).alias("n_taken"))
    whole = F.sum("taken_tokens").over(Window.partitionBy("mix_id"))
    report = (
        plan.join(got, ["mix_id", "source"], "left")
        .fillna(0, ["taken_tokens", "n_taken"])
        .select("mix_id", "source", "target_share", "share", "max_repeats", "n_docs", F.col("available").alias("available_tokens"), "taken_tokens", "n_taken", "epochs", F.coalesce(F.try_divide(F.col("taken_tokens").cast("double"), whole), F.lit(0.0)).alias("actual_share"))
    )
    return taken, report
