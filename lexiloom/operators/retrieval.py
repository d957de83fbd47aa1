"""Retrieval over postings: BM25 terms with spelling tolerance, sloppy phrases, whole-field matches, and their ranking.

The ranker is Okapi BM25 with k1 1.2 and b 0.75. A query's score in a pair is the phrase score times 4 plus the better of
the terms' score times 3 and the whole-field score, ordered by the score to six decimals and then by position.
Postings are stored in shards of pairs, and `shards` scores all queries against each; its parts by themselves are equi-joins
on terms and grouped sums. The vocabulary meets the distinct query terms, by word length and letters, for spelling.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import shards
from lexiloom.operators.shards import K1, B
from lexiloom.plans.shipping import ship
from lexiloom.plans.skew import SMALL_ROWS
from lexiloom.plans.staging import cut

PHRASE_BOOST, TEXT_BOOST, PHRASE_SLOP, SHOULD_MATCH = 4.0, 3.0, 1, 0.6


def _terms(words: DataFrame) -> DataFrame:
    """Words (lang, position, word, bare) that aren't stop words, as terms."""
    kept = words.where(~T.is_stop_bare(F.col("bare"), F.col("lang")))
    return kept.withColumn("term", T.stem_prepared(F.col("word"), F.col("bare"), F.col("lang"))).drop("word", "bare")


def postings(rows: DataFrame) -> DataFrame:
    """(lang, pair_id, term, position) of the rows of by_language."""
    return _terms(T.with_words(rows.select("lang", "pair_id", "text"), "text").drop("text"))


def term_frequencies(posted: DataFrame) -> DataFrame:
    """(lang, term, pair_id, tf)."""
    return posted.groupBy("lang", "term", "pair_id").agg(F.count(F.lit(1)).alias("tf"))


def lengths(posted: DataFrame) -> DataFrame:
    """(lang, pair_id, dl): analysed terms of a text."""
    return posted.groupBy("lang", "pair_id").agg(F.count(F.lit(1)).alias("dl"))


def term_stats(tf: DataFrame) -> DataFrame:
    """(lang, term, df)."""
    return tf.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturated(freq: Column, dl: Column, avg_dl: Column) -> Column:
    return freq * (K1 + 1) / (freq + K1 * (1 - B + B * dl / avg_dl))


@dataclass
class Index:
    """The inverted index of a collection: its rows, stored pieces of postings, vocabulary and figures."""

    rows: DataFrame
    pieces: DataFrame
    stats: DataFrame
    whole: DataFrame

    @cached_property
    def posted(self) -> DataFrame:
        """(lang, pair_id, term, position) as stored."""
        return self.pieces.mapInArrow(shards.decode, shards.POSTED)

    @cached_property
    def tf(self) -> DataFrame:
        return cut(term_frequencies(self.posted))

    @cached_property
    def dl(self) -> DataFrame:
        return lengths(self.posted)


def build(rows: DataFrame) -> Index:
    """Index of the rows of by_language. Texts are taken apart once, into coded pieces of their words; all else is counted from them.

    Only a piece's distinct words are stemmed, as the rules cost far more than taking texts apart. Rows themselves aren't written
    again: they are read anew where hits need their texts."""
    ship(rows.sparkSession)
    placed = rows.select("lang", F.col("pair_id").cast("bigint").alias("pair_id"), F.col("position").cast("bigint").alias("place"), "text")
    words = T.with_words(placed, "text").where(~T.is_stop_bare(F.col("bare"), F.col("lang")))
    raw = cut(words.select("lang", "pair_id", "place", "word", "position").mapInArrow(shards.encode, shards.RAW))
    held = raw.select("lang", "piece", F.posexplode("words").alias("at", "word"))
    terms = _terms(held.select("lang", "word").distinct().withColumns({"as_held": F.col("word"), "bare": T.strip_accents(F.col("word"))})).withColumnRenamed("as_held", "word")
    stems = held.join(terms, ["lang", "word"]).groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("stems")).select("piece", F.col("stems.term").alias("stems"))
    pieces = cut(raw.drop("words").join(stems, "piece").mapInArrow(shards.stemmed, shards.PIECE))
    stats = cut(pieces.select("lang", F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("lang", F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df")))
    totals = posted_totals(pieces)
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return Index(rows, pieces, stats, cut(n.join(totals, "lang", "left").select("lang", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_dl"))))


def posted_totals(pieces: DataFrame) -> DataFrame:
    """(lang, total): how many postings each language has."""
    return pieces.groupBy("lang").agg(F.sum("tokens").alias("total"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, lang, term, position, n_terms); n_terms counts the query's distinct terms."""
    found = _terms(T.with_words(queries.select("query_id", "lang", "q"), "q").drop("q"))
    n = found.groupBy("query_id").agg(F.count_distinct("term").alias("n_terms"))
    return found.join(n, "query_id")


def allowed_edits(length: Column) -> Column:
    """Spelling tolerance by length: none below 3 signs, one up to 5, two beyond."""
    return F.when(length < 3, 0).when(length <= 5, 1).otherwise(2)


def _mask(parts: str) -> Column:
    """The elements of an array as bits of a number: arrays that differ in n elements differ in n bits at most."""
    return F.expr(f"aggregate({parts}, 0L, (m, x) -> m | shiftleft(1L, int(pmod(xxhash64(x), 64))))")


def spellings(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, qterm, term, edits, df): vocabulary terms within the tolerance of the distinct query terms (lang, qterm).

    The vocabulary is met by length, dealt out over buckets, and an edit changes two letters at most, so that few pairs are
    left whose edits are counted."""
    edits = allowed_edits(F.length("qterm"))
    buckets = 16
    wanted = terms.withColumns({"most": edits, "qmask": _mask("split(qterm, '')")}).withColumn("len", F.explode(F.sequence(F.length("qterm") - edits, F.length("qterm") + edits))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    known = stats.withColumns({"len": F.length("term"), "mask": _mask("split(term, '')"), "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")})
    near = wanted.join(known, ["lang", "len", "bucket"]).where(F.bit_count(F.col("mask").bitwiseXOR(F.col("qmask"))) <= 2 * F.col("most"))
    return near.withColumn("edits", F.levenshtein("qterm", "term", 2)).where("edits >= 0 and edits <= most").select("lang", "qterm", "term", "edits", "df")


def expansions(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, lang, qterm, term, edits, df): vocabulary terms within the tolerance of a query term."""
    wanted = asked.select("query_id", "lang", F.col("term").alias("qterm")).distinct()
    return wanted.join(spellings(wanted.select("lang", "qterm").distinct(), stats), ["lang", "qterm"]).select("query_id", "lang", "qterm", "term", "edits", "df")


def term_scores(asked: DataFrame, index: Index) -> DataFrame:
    """(query_id, lang, pair_id, qterm, score): a query term's best expansion in each pair, less for each edit."""
    hits = expansions(asked, index.stats).join(index.tf, ["lang", "term"]).join(index.dl, ["lang", "pair_id"]).join(index.whole, "lang")
    near = 1 - F.col("edits") / F.least(F.length("qterm"), F.length("term"))
    score = idf(F.col("n_docs"), F.col("df")) * saturated(F.col("tf"), F.col("dl"), F.col("avg_dl")) * near
    return hits.withColumn("score", score).groupBy("query_id", "lang", "pair_id", "qterm").agg(F.max("score").alias("score"))


def text_scores(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, lang, pair_id, matched, score) where at least 60 per cent of the query's terms, rounded down, and one, match."""
    need = asked.select("query_id", F.greatest(F.lit(1), F.floor(SHOULD_MATCH * F.col("n_terms"))).alias("need")).distinct()
    return scored.groupBy("query_id", "lang", "pair_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("score").alias("score")).join(need, "query_id").where("matched >= need").drop("need")


def phrases(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """(query_id, lang, pair_id, freq): how often the query's terms stand in order, one step of displacement in all allowed.

    A place where all stand exactly counts 1, one with a displacement counts a half."""
    words = asked.select("query_id", "lang", "term", F.col("position").alias("at")).distinct()
    size = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    shifts = words.join(posted, ["lang", "term"]).withColumn("shift", F.col("position") - F.col("at"))
    starts = shifts.select("query_id", "lang", "pair_id", "at", F.inline(F.array(*(F.struct((F.col("shift") - k).alias("start"), F.lit(int(k == 0)).alias("exact")) for k in range(PHRASE_SLOP + 1)))))
    each = starts.groupBy("query_id", "lang", "pair_id", "start", "at").agg(F.max("exact").alias("exact"))
    whole = each.groupBy("query_id", "lang", "pair_id", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("exact").alias("exact")).join(size, "query_id").where("n = m and exact > 0")
    return whole.groupBy("query_id", "lang", "pair_id").agg(F.sum(F.when(F.col("exact") == F.col("m"), 1.0).otherwise(0.5)).alias("freq"))


#: Texts shorter than this are compared by length alone; longer ones must share one of PARTS stretches, as two edits leave one whole.
SHORT_FIELD, PARTS, MOST_EDITS = 9, 3, 2
#: Bits of the words' mask that an edit changes at most: a blank lost or won makes one word of two or two of one.
WORD_BITS = 3


def near_fields(asked: DataFrame, fields: DataFrame, rows: int | None = None) -> DataFrame:
    """(query_id, lang, pair_id): pairs (lang, pair_id, field) whose field may be within the tolerance of a query's.

    A field in three stretches keeps one of them through two edits, moved by two signs at most; stretches meet by hash, and the
    words' masks leave out nearly all that share a stretch only. rows: the number of queries, if counted."""
    size = F.length("qfield")
    short = asked.where(size < SHORT_FIELD).withColumn("len", F.explode(F.sequence(size - MOST_EDITS, size + MOST_EDITS)))
    by_length = short.join(fields.withColumn("len", F.length("field")).where(F.col("len") < SHORT_FIELD + MOST_EDITS), ["lang", "len"])
    start = [f"{k} * (len div {PARTS})" for k in range(PARTS)]
    length = [*[f"len div {PARTS}"] * (PARTS - 1), f"len - {PARTS - 1} * (len div {PARTS})"]
    cuts = lambda text, shift: F.expr("array(" + ", ".join(f"xxhash64(lang, len, {k}, substring({text}, 1 + {start[k]} + {shift}, {length[k]}))" for k in range(PARTS)) + ")")
    masked = asked.where(size >= SHORT_FIELD).withColumn("qmask", _mask("split(qfield, ' ')")).withColumn("len", F.explode(F.sequence(size - MOST_EDITS, size + MOST_EDITS)))
    wanted = masked.withColumn("shift", F.explode(F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS)))).withColumn("part", F.explode(cuts("qfield", "shift"))).select("query_id", "lang", "qmask", "part").distinct()
    known = fields.withColumn("len", F.length("field")).where(F.col("len") >= SHORT_FIELD - MOST_EDITS).select("lang", "pair_id", _mask("split(field, ' ')").alias("mask"), F.explode(cuts("field", "0")).alias("part"))
    if rows is not None and rows * PARTS * 25 <= SMALL_ROWS:
        wanted = F.broadcast(wanted)
    by_part = known.join(wanted, ["lang", "part"]).where(F.bit_count(F.col("mask").bitwiseXOR(F.col("qmask"))) <= WORD_BITS * MOST_EDITS)
    columns = ["query_id", "lang", "pair_id"]
    return by_length.select(*columns).unionByName(by_part.select(*columns)).distinct()


def field_scores(queries: DataFrame, index: Index, rows: int | None = None) -> DataFrame:
    """(query_id, lang, pair_id, position, score): texts that equal the query as a whole but for case and accents, within the spelling tolerance."""
    asked = queries.select("query_id", "lang", T.fold(T.trim(F.col("q"))).alias("qfield")).where("qfield <> ''")
    shortest, longest = asked.agg(F.min(F.length("qfield")), F.max(F.length("qfield"))).first()
    within = lambda c: F.length(c).between((shortest or 0) - MOST_EDITS, (longest or 0) + MOST_EDITS)
    # folding keeps the length of all texts but those with marks and ligatures, so others that are too long or short go first
    low = index.rows.select("lang", "pair_id", F.lower("text").alias("low")).where(within("low") | F.col("low").rlike(r"[\p{Mn}œæ]"))
    fields = low.select("lang", "pair_id", T.unligated(T.bare(F.col("low"))).alias("field"))
    fields = fields.where(within("field"))
    met = cut(near_fields(asked, fields, rows))
    few = F.broadcast(met) if met.count() <= SMALL_ROWS else met
    placed = index.rows.select("lang", "pair_id", "position", "text").join(few, ["lang", "pair_id"]).join(asked, ["query_id", "lang"]).withColumn("field", T.fold(F.col("text")))
    near = cut(placed.withColumn("edits", F.levenshtein("qfield", "field", MOST_EDITS)).where((F.col("edits") >= 0) & (F.col("edits") <= allowed_edits(F.length("qfield")))))
    df = near.select("lang", "field", "pair_id").distinct().groupBy("lang", "field").agg(F.count(F.lit(1)).alias("df"))
    score = idf(F.col("n_docs"), F.col("df")) * (1 - F.col("edits") / F.least(F.length("qfield"), F.length("field")))
    return near.join(df, ["lang", "field"]).join(index.whole, "lang").select("query_id", "lang", "pair_id", "position", score.alias("score"))


def ranked(queries: DataFrame, index: Index, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, lang, pair_id, position, score, rank): each query's best pairs, at most its limit.

    queries: (query_id, q, lang, limit). A pair needs a phrase, enough terms, or the whole field. Shards of pairs meet blocks of
    queries, and each hands on as many pairs of a query as its limit; the largest limit and the number of queries are read first.
    asked: the queries' terms, if they are worked out already."""
    most, rows = queries.agg(F.max("limit"), F.count(F.lit(1))).first()
    asked = cut(query_terms(queries)) if asked is None else asked
    blocks = -(-max(rows, 1) // shards.BLOCK)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    id_type = dict(queries.dtypes)["query_id"]

    def part(df: DataFrame, kind: int, **named) -> DataFrame:
        types = {"query_id": id_type, "a": "string", "b": "string", "n": "bigint", "m": "bigint", "x": "double", "y": "double"}
        return df.select("lang", "block", *(["shard"] if kind == shards.FIELD else []), F.lit(kind).alias("kind"), *(named.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))

    c = F.col
    near = 1 - c("edits") / F.least(F.length("qterm"), F.length("term"))
    met = spellings(asked.select("lang", c("term").alias("qterm")).distinct(), index.stats).join(index.whole, "lang").select("lang", "qterm", "term", (idf(c("n_docs"), c("df")) * near).alias("weight"))
    of_block = asked.select("lang", c("term").alias("qterm"), block.alias("block")).distinct().join(met, ["lang", "qterm"])
    slots = asked.select("query_id", "lang", "term", "position", "n_terms").distinct()
    sums = slots.join(index.stats, ["lang", "term"]).join(index.whole, "lang").groupBy("query_id").agg(F.sum(idf(c("n_docs"), c("df"))).alias("idf"))
    heads = queries.select("query_id", "lang", F.coalesce("limit", F.lit(0)).alias("limit")).join(asked.select("query_id", "n_terms").distinct(), "query_id", "left").join(sums, "query_id", "left").join(index.whole, "lang")
    asks = part(of_block, shards.EXPANSION, a=c("qterm"), b=c("term"), x=c("weight")).unionByName(part(slots.withColumn("block", block), shards.TERM, query_id=c("query_id"), a=c("term"), n=c("position")))
    asks = cut(asks.unionByName(part(heads.withColumn("block", block), shards.QUERY, query_id=c("query_id"), n=F.coalesce("n_terms", F.lit(0)), m=c("limit"), x=F.coalesce("idf", F.lit(0.0)), y=c("avg_dl"))))
    fields = field_scores(queries, index, rows).withColumns({"block": block, "shard": F.shiftright(c("pair_id").cast("bigint"), shards.SHARD_BITS)})
    fields = cut(part(fields, shards.FIELD, query_id=c("query_id"), n=c("pair_id"), m=c("position"), x=c("score")))
    there = cut(index.pieces.select("lang", "shard").unionByName(fields.select("lang", "shard")).distinct())
    # the number of shards, one for 65536 pairs, is read to give each meeting of a shard and a block a task of its own
    tasks = min(max(3 * there.count() * blocks, 1), 5000)
    key = ["lang", "shard", "block"]
    right = asks.join(F.broadcast(there), "lang").unionByName(fields).repartition(tasks, *key)
    left = index.pieces.select(*(c(k).alias(k) for k in ("lang", "shard", "pairs", "places", "counts", "ats", "codes", "terms"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *key)
    schema = f"query_id {id_type}, lang string, pair_id bigint, position bigint, score double"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(shards.scorer(PHRASE_BOOST, TEXT_BOOST, SHOULD_MATCH), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    best = found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= int(most or 0))
    return best.join(queries.select("query_id", "limit"), "query_id").where("rank <= limit").select("query_id", "lang", "pair_id", "position", "score", "rank")


def matched_terms(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, terms): the vocabulary terms that a query's terms match, spelling tolerated."""
    return expansions(asked, stats).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def marked(text: Column, lang: Column, terms: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The whole text with every word whose analysed form is among `terms` between the marks; all else as it was.

    Words and what stands between them are taken apart by position, so marks can't be marked again."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    words = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.lower(p).alias("word"), T.strip_accents(F.lower(p)).alias("bare")))

    def mark(x: Column) -> Column:
        hit = x["piece"].rlike(r"^[\p{L}\p{N}]") & ~T.is_stop_bare(x["bare"], lang) & F.array_contains(terms, T.stem_prepared(x["word"], x["bare"], lang))
        return F.when(hit, F.concat(F.lit(before), x["piece"], F.lit(after))).otherwise(x["piece"])

    return F.array_join(F.transform(words, mark), "")
