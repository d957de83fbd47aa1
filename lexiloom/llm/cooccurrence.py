"""Items that appear together: exact counts, and how far they exceed a fitted chance model.

The null is the bipartite configuration model: item a is in record r with probability x_a y_r / (1 + x_a y_r), fitted so that
every item's frequency and every record's size are met on average. Two items then meet in a Poisson-binomial number of
records; its upper tail at the count observed, by saddle point, is the surprise, and Benjamini-Hochberg over all pairs of
items controls the false discovery rate. Only sizes and frequencies enter the fit, so the driver holds histograms of
bounded length, never items or records.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.lexicon import lexicon_of
from lexiloom.plans.skew import ROWS_PER_REPLICA, SMALL_ROWS, join_many, join_unique
from lexiloom.plans.staging import cut

#: Record sizes above this are read in classes a sixteenth of a doubling wide, so there are at most some hundreds.
EXACT_SIZES = 64
#: Classes of item frequencies in the fit per doubling.
FREQUENCY_STEPS = 16
#: Width of the classes of -log10(p) over which false discoveries are controlled; q is rounded up to the class.
P_STEP = 0.01


def _size_class(n):
    """The size that stands for a record's size."""
    wide = F.pow(F.lit(2.0), F.round(F.log2(F.greatest(n, F.lit(1))) * 16) / 16)
    return F.when(n <= EXACT_SIZES, n.cast("double")).otherwise(wide)


def memberships(df: DataFrame, id_col: str, left_col: str, right_col: str) -> DataFrame:
    """(record, side, stem), each once: side 0 for the left array's items, 1 for the right one's."""
    both = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left_col).alias("stems")), F.struct(F.lit(1).alias("side"), F.col(right_col).alias("stems")))).alias("s"))
    return both.select("record", "s.side", F.explode("s.stems").alias("stem")).where("stem is not null").distinct()


def fit(sizes: np.ndarray, records: np.ndarray, frequencies: np.ndarray, items: np.ndarray, rounds: int = 500) -> np.ndarray:
    """y of each size class of records; sizes with their numbers of records, frequencies with their numbers of items."""
    total = float((sizes * records).sum()) or 1.0
    x, y = frequencies / math.sqrt(total), sizes / math.sqrt(total)
    for _ in range(rounds):
        x_new = frequencies / np.maximum((records * y / (1 + np.outer(x, y))).sum(1), 1e-300)
        y_new = sizes / np.maximum((items * x_new / (1 + np.outer(y, x_new))).sum(1), 1e-300)
        moved = max(np.abs(x_new / np.maximum(x, 1e-300) - 1).max(initial=0), np.abs(y_new / np.maximum(y, 1e-300) - 1).max(initial=0))
        x, y = np.minimum(x_new, 1e12), np.minimum(y_new, 1e12)
        if moved < 1e-9:
            break
    return y


def item_strength(n: np.ndarray, y: np.ndarray, records: np.ndarray) -> np.ndarray:
    """x of items with frequency n, by bisection on a logarithmic scale; vectorised over items."""
    low, high = np.full(len(n), -40.0), np.full(len(n), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        z = np.exp(mid)[:, None] * y
        below = (records * z / (1 + z)).sum(1) < n
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.exp((low + high) / 2)


def _normal_tail(w: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in w])


def tail(k: np.ndarray, chance: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each row's Poisson-binomial sum and P(sum >= k). chance: rows by classes; records: number of each class.

    Lugannani and Rice's saddle point with the lattice's correction; next to the mean, the normal law with half a step."""
    mean = chance @ records
    var = np.maximum((chance * (1 - chance)) @ records, 1e-300)
    t = np.log(np.maximum(k, 1e-9) / np.maximum(mean, 1e-300))
    most = (records * (chance > 0)).sum(1)
    inside = (k > mean) & (k < most)
    t = np.where(inside, t, 0.0)
    for _ in range(30):
        e = np.exp(np.minimum(t, 700))[:, None]
        q = chance * e / (1 - chance + chance * e)
        gap = q @ records - k
        step = np.where(inside, gap / np.maximum((q * (1 - q)) @ records, 1e-300), 0.0)
        t = np.maximum(t - np.clip(step, -2, 2), 0.0)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    e = np.exp(np.minimum(t, 700))[:, None]
    q = chance * e / (1 - chance + chance * e)
    cumulant = np.log1p(chance * (e - 1)) @ records
    w = np.sqrt(np.maximum(2 * (t * k - cumulant), 0))
    u = -np.expm1(-t) * np.sqrt(np.maximum((q * (1 - q)) @ records, 1e-300))
    normal = _normal_tail((k - 0.5 - mean) / np.sqrt(var))
    far = inside & (w > 0.05) & (u > 0)
    w_, u_ = np.where(far, w, 1.0), np.where(far, u, 1.0)
    saddle = _normal_tail(w_) + np.exp(-w_ * w_ / 2) / math.sqrt(2 * math.pi) * (1 / u_ - 1 / w_)
    sure = np.where((k <= 0), 1.0, normal)
    at_most = np.exp(np.log(np.maximum(chance, 1e-300)) @ records)  # all of them
    out = np.where(far, saddle, np.where(k >= most, at_most, sure))
    return mean, np.clip(out, 0.0, 1.0)


def cooccurring(df: DataFrame, id_col: str = "pair_id", left_col: str = "stems_en", right_col: str = "stems_fr", min_count: int = 1, min_lift: float = 0.0, replica_rows: int = ROWS_PER_REPLICA) -> DataFrame:
    """(left, right, n_ab, n_a, n_b, n_records, lift, expected, p_value, q_value) of all pairs that occur together.

    A record is a distinct id; its items are those of any row with that id, each once; null ids, null arrays and null
    items hold nothing, but a record with empty arrays counts in n_records. lift is n_ab * n_records / (n_a * n_b).
    expected and p_value come from the fitted null, q_value from false-discovery control in which every left item with every right
    item is a test, whether they meet or not, so that leaving pairs out doesn't flatter the rest. Pairs with the same
    (n_a, n_b, n_ab) are judged once. min_count and min_lift leave out pairs below them, where the frequencies alone rule them out
    before any pair is formed, without loss. A record with a large part of all items is dealt out over many tasks. Empty tables give an empty result; repeated rows and other columns don't matter."""
    spark = df.sparkSession
    held = cut(memberships(df, id_col, left_col, right_col))
    n_records = df.where(F.col(id_col).isNotNull()).select(id_col).distinct().count()
    frequency = cut(held.groupBy("side", "stem").agg(F.count(F.lit(1)).alias("n")))
    figures = {r.side: r for r in frequency.groupBy("side").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("items")).collect()}
    total, items = sum(r.total for r in figures.values()), [figures[k].items if k in figures else 0 for k in (0, 1)]
    sizes = held.groupBy("record").agg(F.sum(F.expr("cast(side = 0 as int)")).alias("a"), F.sum(F.expr("cast(side = 1 as int)")).alias("b"))
    shape = sizes.groupBy(_size_class(F.col("a")).alias("a"), _size_class(F.col("b")).alias("b")).agg(F.count(F.lit(1)).alias("m")).collect()
    step = F.floor(F.log2("n") * FREQUENCY_STEPS)
    spread = frequency.groupBy("side", step.alias("step")).agg(F.avg("n").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    classes = np.array([(r.a, r.b, r.m) for r in shape], float).reshape(-1, 3)
    ys = []
    for side in (0, 1):
        values, where = np.unique(classes[:, side], return_inverse=True)
        number = np.bincount(where, classes[:, 2], minlength=len(values))
        of_side = np.array([(r.n, r.m) for r in spread if r.side == side], float).reshape(-1, 2)
        keep = values > 0
        y = np.zeros(len(values))
        if keep.any() and len(of_side):
            y[keep] = fit(values[keep], number[keep], of_side[:, 0], of_side[:, 1])
        ys.append((y, number, y[where]))
    records = classes[:, 2]

    usable = frequency.where(F.col("n") >= min_count)
    if min_lift > 0:
        usable = usable.where(F.col("n") * float(min_lift) <= n_records)
    # each item carries its frequency into the pairs, which are counted where they are formed, before anything is shuffled
    sized = join_unique(held, usable, ["side", "stem"], "n", total, sum(items))
    sized = sized if sum(items) <= SMALL_ROWS else cut(sized)
    left = sized.where("side = 0").select("record", F.col("stem").alias("left"), F.col("n").alias("n_a"))
    right = sized.where("side = 1").select("record", F.col("stem").alias("right"), F.col("n").alias("n_b"))
    largest = float(classes[:, 0].max(initial=0)) * 2 ** (1 / 16)
    met = join_many(left, right, "record", "left", replica_rows, largest)
    enough = (F.col("n_ab") >= min_count) & (F.col("n_ab") * float(n_records) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    counted = cut(met.groupBy("left", "right", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n_ab")).where(enough))
    rows = max(1, 2_000_000 // max(1, len(records)))

    def surprise(frames):
        for frame in frames:
            xs = []
            for n, (y, number, _) in zip((frame.n_a, frame.n_b), ys):
                known, where = np.unique(n.to_numpy(), return_inverse=True)
                xs.append(item_strength(known.astype(float), y, number)[where] if len(known) else np.zeros(0))
            mean, p = np.zeros(len(frame)), np.zeros(len(frame))
            for i in range(0, len(frame), rows):
                z = [np.outer(x[i : i + rows], y) for x, (_, _, y) in zip(xs, ys)]
                chance = (z[0] / (1 + z[0])) * (z[1] / (1 + z[1]))
                mean[i : i + rows], p[i : i + rows] = tail(frame.n_ab.to_numpy()[i : i + rows].astype(float), chance, records)
            yield frame.assign(expected=mean, p_value=p)

    shapes = counted.groupBy("n_a", "n_b", "n_ab").agg(F.count(F.lit(1)).alias("pairs_"))
    judged = cut(shapes.mapInPandas(surprise, "n_a bigint, n_b bigint, n_ab bigint, pairs_ bigint, expected double, p_value double"))
    place = F.floor(-F.log10(F.greatest("p_value", F.lit(1e-300))) / P_STEP).cast("int")
    found = np.array([(r.place, r.m, r.shapes) for r in judged.groupBy(place.alias("place")).agg(F.sum("pairs_").alias("m"), F.count(F.lit(1)).alias("shapes")).collect()], float).reshape(-1, 3)
    found = found[np.argsort(-found[:, 0])]
    tests = max(1.0, float(items[0]) * items[1])
    q = np.minimum(1.0, 10.0 ** (-found[:, 0] * P_STEP) * tests / np.cumsum(found[:, 1])) if len(found) else np.zeros(0)
    q = np.minimum.accumulate(q[::-1])[::-1]
    levels = spark.createDataFrame(pd.DataFrame({"place": found[:, 0].astype(int), "q_value": q}), "place int, q_value double")
    shaped = judged.withColumn("place", place).join(F.broadcast(levels), "place").drop("place")
    return join_unique(counted, shaped, ["n_a", "n_b", "n_ab"], "pairs_", int(found[:, 1].sum()), int(found[:, 2].sum())).select(
        "left", "right", "n_ab", "n_a", "n_b", F.lit(n_records).cast("bigint").alias("n_records"), (F.col("n_ab").cast("double") * n_records / F.col("n_a") / F.col("n_b")).alias("lift"), "expected", "p_value", "q_value"
    )


def translations(df: DataFrame, id_col: str = "pair_id", least: float = 0.1) -> DataFrame:
    """The lexicon of pairs with a Dice coefficient of at least `least`, in both directions:
    (source_stem, source_lang, target_stem, target_lang, score, co_occurrence_count, source_count, target_count).

    Memberships are those of `cooccurring`."""
    held = memberships(df, id_col, "stems_en", "stems_fr").select("record", F.when(F.col("side") == 0, "en").otherwise("fr").alias("lang"), "stem")
    return lexicon_of(cut(held), "record", least)
