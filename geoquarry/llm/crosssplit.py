"""Problem 3: same or near-same records across splits, by winnowed fingerprints, collinear chains and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.text import image_name, words
from geoquarry.llm.records import objects
from geoquarry.storage import materialize

SKETCH = 1 << 14


def questions(records: DataFrame) -> DataFrame:
    """kind, place, key, train and words of the rows of ``records`` that have an image, a question with words and a split."""
    return _texts(records.select(F.lit("question").alias("kind"), image_name(F.col("image_id")).alias("place"), F.col("rec_id").alias("key"), "split", F.col("question").alias("text")))


def sentences(annotations: DataFrame) -> DataFrame:
    """As ``questions``, of the referring sentences of all objects."""
    return _texts(objects(annotations).select(F.lit("referring").alias("kind"), F.col("image").alias("place"), "key", "split", F.col("referring_sentence").alias("text")))


def _texts(rows: DataFrame) -> DataFrame:
    split = F.lower(F.trim("split"))
    known = F.col("place").isNotNull() & split.isin("train", "val", "test") & F.col("key").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]")
    kept = shared_places(rows.where(known).select("kind", "place", "key", (split == "train").alias("train"), "text"))
    return kept.select("kind", "place", "key", "train", F.array_distinct(words(F.col("text"))).alias("words"))


def shared_places(texts: DataFrame) -> DataFrame:
    """The texts of places that have a text in train and one in val or test; no other can form a pair."""
    both = texts.groupBy("kind", "place").agg(F.max("train").alias("_t"), F.min("train").alias("_e")).where("_t and not _e").select("kind", "place")
    return texts.join(both, ["kind", "place"], "left_semi")


def classed(texts: DataFrame) -> DataFrame:
    """Adds ``c``, two 64-bit hashes of place and word set: rows with the same ``c`` are one class of equal texts."""
    sorted_words = F.array_sort("words")
    return texts.withColumn("c", F.struct(F.xxhash64("kind", "place", sorted_words).alias("x"), F.xxhash64(F.lit(1), sorted_words, "place", "kind").alias("y")))


def rare_first(texts: DataFrame) -> DataFrame:
    """Puts each text's words in one common order, rarer words first.

    The order is by count in a sketch of 16,384 buckets over the words of all
    texts, then by hash. The sketch has the same size for any input, and any
    common order gives the same pairs; a better one only gives fewer
    candidates.
    """
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(SKETCH)).cast("int")
    counted = texts.select(F.explode("words").alias("w")).groupBy(bucket(F.col("w")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * SKETCH
    for r in counted:
        counts[r["k"]] = r["n"]
    table = F.from_json(F.lit("[" + ",".join(map(str, counts)) + "]"), "array<bigint>")
    keyed = F.transform("words", lambda w: F.struct(F.element_at(table, bucket(w) + 1).alias("n"), F.xxhash64(w).alias("h"), w.alias("w")))
    return texts.withColumn("words", F.transform(F.array_sort(keyed), lambda x: x["w"]))


def others(share: float) -> Column:
    """The most words that a text may have to itself, or another text, in a pair that shares ``share``."""
    return F.floor(F.size("words") * F.lit((1 - share) / share) + 1e-9).cast("int")


def rolling(texts: DataFrame, share: float) -> DataFrame:
    """Adds ``rolled``: the rolling hashes of two words each over the first 3 (e + 1) words, and ``e`` itself."""
    last = F.least(F.size("words"), 3 * (F.col("e") + 1)) - 1
    near = F.zip_with(F.slice("words", 1, last), F.slice("words", 2, last), lambda v, w: F.xxhash64("kind", "place", v, w))
    none = F.array().cast("array<bigint>")
    return texts.withColumn("e", others(share)).withColumn("rolled", F.when(F.size("words") > 1, near).otherwise(none))


def fingerprints(share: float) -> Column:
    """Winnowed fingerprints of a text with ``rolling`` hashes: (hash, place) of the least hash of every window.

    Rolling hashes are of two words each. Let two word sets share o words
    and hold e others; for ``share`` of the union, e <= o (1 - share) / share,
    so the e of a text of n words is n (1 - share) / share at most. The e
    others cut the first 3 (e + 1) words of the union into e + 1 stretches,
    so one of them has three shared words in a row, in both texts: two
    rolling hashes side by side, a whole window. The least hash of a window
    of two is therefore selected in both, within the first 3 (e + 1) words;
    frequent words at the far end are never looked up. A text of fewer words
    than that has windows of one, which select every hash, so that two
    shared words in a row suffice; o >= 4 e makes sure of them for a share
    of 0.8 (for lower shares, all single words are fingerprints too). A text
    too short for any other word equals whatever it is near to, and its
    class needs no fingerprint.
    """
    n = F.size("words")
    none = F.array().cast("array<struct<f:bigint,i:int>>")
    every = F.transform("rolled", lambda h, i: F.struct(h.alias("f"), (i + 1).alias("i")))
    after = F.slice("rolled", 2, F.greatest(F.size("rolled") - 1, F.lit(0)))
    windows = F.transform(F.arrays_zip(F.slice("rolled", 1, F.greatest(F.size("rolled") - 1, F.lit(0))).alias("x"), after.alias("y")), lambda p, i: F.when(p["x"] <= p["y"], F.struct(p["x"].alias("f"), (i + 1).alias("i"))).otherwise(F.struct(p["y"].alias("f"), (i + 2).alias("i"))))
    chosen = F.when(n < 3 * (F.col("e") + 1), every).otherwise(F.array_distinct(windows))
    if share < 0.8:
        return F.concat(chosen, F.transform("words", lambda w, i: F.struct(F.xxhash64("kind", "place", w).alias("f"), (i + 1).alias("i"))))
    return F.when(F.col("e") > 0, chosen).otherwise(none)


def signature(words: Column) -> Column:
    """64 parities of the words' hashes; two signatures differ in no more bits than the two sets in words."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))


def chain_bound(seeds: Column, n: Column, m: Column) -> Column:
    """The most words that two texts can share along the chain of ``seeds`` (i, j), places from 1 in texts of n and m words.

    In the common order all seeds of a pair lie on one rising line. Between
    two seeds no more words match than the shorter gap has; the same holds
    before the first and after the last.
    """
    step = lambda s, x: F.struct((s["most"] + F.least(x["i"] - s["i"], x["j"] - s["j"])).alias("most"), x["i"].alias("i"), x["j"].alias("j"))
    start = F.struct(F.lit(0).alias("most"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    return F.aggregate(F.array_sort(seeds), start, step, lambda s: s["most"] + F.least(n - s["i"], m - s["j"]))


def class_pairs(classes: DataFrame, share: float) -> DataFrame:
    """a, b, shared and either: pairs of different classes, ``a`` with a text of train and ``b`` with one of val or test."""
    seeds = rolling(classes, share).select("c", "kind", "train", "eval", F.size("words").alias("n"), signature(F.col("words")).alias("s"), F.explode(fingerprints(share)).alias("p")).select("*", "p.f", "p.i")
    left = seeds.where("train").select("f", F.col("c").alias("a"), "n", "s", "i")
    right = seeds.where("eval").select("f", F.col("c").alias("b"), F.col("n").alias("m"), F.col("s").alias("_s"), F.col("i").alias("j"))
    # e words in one text only and o in both: e <= o (1 - share) / share, and 2 o + e words in all.
    most = (F.col("n") + F.col("m")) * F.lit((1 - share) / (1 + share)) + 1e-6
    fewest = (F.col("n") + F.col("m")) * F.lit(share / (1 + share)) - 1e-6
    reach = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    close = (F.bit_count(F.col("s").bitwiseXOR(F.col("_s"))) <= most) & (reach >= fewest) & (F.col("a") != F.col("b"))
    chains = left.join(right, (left["f"] == right["f"]) & close).groupBy("a", "b", "n", "m").agg(F.collect_set(F.struct("i", "j")).alias("seeds"))
    chained = chains.where(chain_bound(F.col("seeds"), F.col("n"), F.col("m")) >= fewest).select("a", "b")
    side = lambda t, key, out: classes.where(t).select(F.col("c").alias(key), F.col("words").alias(out))
    pairs = chained.join(side("train", "a", "v"), "a").join(side("eval", "b", "w"), "b")
    # Two sequences in one order, without repeats: their best alignment matches exactly the words they share.
    shared = F.size(F.array_intersect("v", "w"))
    measured = pairs.select("a", "b", shared.alias("shared"), (F.size("v") + F.size("w") - shared).alias("either"))
    return measured.where(F.col("shared") >= F.col("either") * share - 1e-9)


def near_pairs(texts: DataFrame, share: float = 0.8) -> DataFrame:
    """All pairs of a train text and a val or test text of one place that share ``share`` of their words.

    Returns kind, train_key, eval_key and the words shared and in either.
    Rows with the same words in one place are one class, so copies are
    compared once. Winnowed fingerprints of the classes are joined on place
    and rolling hash, with their places in the text; a seed is dropped in
    the join where the signatures or the places leave too few shared words.
    The seeds of a pair are chained, the chain bounds what it can reach, and
    the pairs left are aligned over all words. Classes are expanded into
    their rows last. Repeated rows are pairs of their own; a text without
    words, an image or a known split is in none.
    """
    rows = materialize(classed(texts), "rows")
    grouped = rows.groupBy("c", "kind", "place").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"), F.first("words").alias("words"))
    classes = materialize(rare_first(materialize(grouped, "classes")), "texts")
    found = class_pairs(classes, share).unionByName(classes.where("train and eval").select(F.col("c").alias("a"), F.col("c").alias("b"), F.size("words").alias("shared"), F.size("words").alias("either")))
    side = lambda t, key, out: rows.where(t).select("kind", F.col("c").alias(key), F.col("key").alias(out))
    return materialize(found, "pairs").join(side("train", "a", "train_key"), "a").join(side("not train", "b", "eval_key").drop("kind"), "b").select("kind", "train_key", "eval_key", "shared", "either")


def record_coverage(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Every row of ``records`` (kind, eval_key, split, source) with its number of pairs and its coverage.

    The coverage is the largest share of words it has in common with a row
    of train; null where it forms no pair.
    """
    best = pairs.groupBy("kind", "eval_key").agg(F.count(F.lit(1)).alias("pairs"), F.max(F.col("shared") / F.col("either")).alias("coverage"))
    return records.join(best, ["kind", "eval_key"], "left").select("kind", "eval_key", "split", "source", F.coalesce("pairs", F.lit(0)).alias("pairs"), "coverage")


def overlap_report(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Totals of ``record_coverage`` by kind and the evaluation row's split and source: rows found, pairs, mean and full coverage."""
    return record_coverage(pairs, records).groupBy("kind", "split", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("coverage").alias("overlapping"), F.sum("pairs").alias("pairs"), F.count_if(F.col("coverage") == 1).alias("whole"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
