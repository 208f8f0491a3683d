"""Problem 9: evaluation passages inside training text, by MinHash containment search over documents partitioned by size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.storage import materialize

SHINGLE = 5
#: The chance at most that the search overlooks a pair at its threshold.
MISS = 1e-6
#: Item signatures are broadcast up to so many rows (24 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one row, and where each text begins and ends in it.

    Words are longest runs of letters and digits, lower case. Each distinct
    word of the batch is hashed once. Null and wordless texts are empty.
    """
    import xxhash

    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+", " "), " ")
    parts = pc.split_pattern(plain, " ")
    words = pc.dictionary_encode(parts.flatten())
    hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in words.dictionary.to_pylist()], dtype=np.uint64)
    flat = hashes[words.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64)
    ends = np.asarray(parts.offsets.to_numpy(), dtype=np.int64)
    ends = ends - ends[0]
    # A wordless text is split into one empty word, which is dropped.
    empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    keep = np.ones(len(flat), bool)
    keep[ends[:-1][empty]] = False
    sizes = np.diff(ends) - empty
    return flat[keep], np.concatenate([[0], np.cumsum(sizes)])


def shingle_table(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every run of ``width`` words; 64-bit hashes of the words' hashes in order."""
    flat, ends = word_table(texts)
    sizes = np.diff(ends)
    counts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = ends[:-1][owner] + place
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = (h ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return owner, place, h


def load(need: int, agree: int, miss: float = MISS) -> float:
    """Shingles a bin may hold on average, so that fewer than ``agree`` of ``need`` shared shingles are least in their bins with a chance of ``miss`` at most."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        lost = sum(math.comb(need, i) * p**i * (1 - p) ** (need - i) for i in range(agree))
        low, high = (low, p) if lost <= miss else (p, high)
    # A shared shingle is the least of a bin of load x with a chance of (1 - exp(-x)) / x.
    few, many = 1e-9, 8.0
    for _ in range(60):
        x = (few + many) / 2
        few, many = (x, many) if (1 - math.exp(-x)) / x >= high else (few, x)
    return few


def partition_of(size: np.ndarray) -> np.ndarray:
    """The size partition of a set: the power of two that bounds it."""
    return np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)


def _minima(owner: np.ndarray, h: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Places in ``h`` of the MinHash signature: for each owner the least hash of every bin that holds any."""
    b = h % bins
    order = np.lexsort((h, b, owner))
    o, c = owner[order], b[order]
    first = np.ones(len(order), bool)
    first[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
    return order[first]


def _bins(part: np.ndarray, most: int, load_: float) -> np.ndarray:
    """Number of bins of a partition: sized by its threshold, need / (upper bound + item - need) of the union."""
    return np.maximum(1, np.ceil((np.exp2(part) + most) / load_)).astype(np.uint64)


def document_signatures(texts: DataFrame, width: int, most: int, load_: float) -> DataFrame:
    """id, part, m: the MinHash signatures of ``texts`` (id, text), each with as many bins as its size partition takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                owner, _, h = shingle_table(rows.column(1), width)
                part = partition_of(np.bincount(owner, minlength=rows.num_rows))
                chosen = _minima(owner, h, _bins(part, most, load_)[owner])
                ids = rows.column(0).take(pa.array(owner[chosen]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(part[owner[chosen]].astype(np.int32)), pa.array(h[chosen].view(np.int64))], ["id", "part", "m"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, part int, m bigint")


def item_signatures(texts: DataFrame, width: int, most: int, load_: float, parts: int) -> DataFrame:
    """id, part, m: for each size partition below ``parts`` the MinHash signature of ``texts`` under the partition's bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, _, h = shingle_table(batch.column(1), width)
            for part in range(parts):
                chosen = _minima(owner, h, np.full(len(h), _bins(np.array([part]), most, load_)[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[chosen])), pa.array(np.full(len(chosen), part, np.int32)), pa.array(h[chosen].view(np.int64))], ["id", "part", "m"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, part int, m bigint")


def shingles(texts: DataFrame, width: int) -> DataFrame:
    """id, place, s: every shingle of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                owner, place, h = shingle_table(rows.column(1), width)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["id", "place", "s"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, place int, s bigint")


def _bounded(rows: DataFrame) -> DataFrame:
    """A written table with the hint its counted size allows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def candidates(documents: DataFrame, items: DataFrame, need: int, most: int, width: int = SHINGLE) -> DataFrame:
    """doc_id, item_id: pairs of ``documents`` (id, text) and ``items`` (id, text) whose signatures agree.

    A pair that shares ``need`` shingles or more, of items with ``most`` at
    most, is found with a chance of 1 - ``MISS`` or more. Documents fall into
    partitions by the number of their shingles, bounded by powers of two;
    with an upper bound u, ``need`` shared shingles are a similarity of
    need / (u + most - need) or more, and the partition's signatures have as
    many bands as that threshold takes: bins of one permutation, each with
    its least hash. Two agreeing bands make a candidate, one if only one
    shingle is needed.
    """
    agree = min(2, need)
    per_bin = load(need, agree)
    longest = documents.agg(F.max(F.length("text"))).first()[0] or 0
    parts = int(partition_of(np.array([longest // 2 + 1]))[0]) + 1
    wanted = materialize(item_signatures(items, width, most, per_bin, parts), "items")
    hits = document_signatures(documents, width, most, per_bin).withColumnRenamed("id", "doc_id").join(_bounded(wanted.withColumnRenamed("id", "item_id")), ["part", "m"])
    return hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= agree).select("doc_id", "item_id")


def matches(documents: DataFrame, items: DataFrame, need: int, most: int, width: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, i, j: the places of every shingle that a document of a candidate pair shares with the item."""
    found = materialize(candidates(documents, items, need, most, width), "candidates")
    some = documents.join(found.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    wanted = materialize(shingles(items, width), "shingles")
    right = _bounded(wanted.select(F.col("id").alias("item_id"), F.col("place").alias("j"), "s"))
    both = shingles(some, width).select(F.col("id").alias("doc_id"), F.col("place").alias("i"), "s").join(right, "s")
    return both.join(found.hint("shuffle_hash"), ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "i", "j", "s")


def _sides(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = lambda t, key, text: t.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return ids(documents, "doc_id", "text"), ids(items, "item_id", "passage")


def _words(text: str) -> Column:
    return F.size(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def run_needs(items: DataFrame, run: int, width: int = SHINGLE) -> DataFrame:
    """id, need: for each item of ``run`` words or more, how many distinct shingles any of its runs has at least (fewer where words repeat)."""
    span = run - width + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, _, h = shingle_table(batch.column(1), width)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            keys, needs = [], []
            for k in range(batch.num_rows):
                own = h[ends[k] : ends[k + 1]]
                if len(own) >= span:
                    windows = np.sort(np.lib.stride_tricks.sliding_window_view(own, span), axis=1)
                    keys.append(k), needs.append(1 + int((windows[:, 1:] != windows[:, :-1]).sum(axis=1).min()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(needs, pa.int32())], ["id", "need"])

    return items.select("id", "text").mapInArrow(work, f"id {items.schema['id'].dataType.simpleString()}, need int")


def leaks(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """doc_id, item_id: documents (doc_id, text) that hold ``run`` consecutive words of an item's passage (item_id, passage).

    Such a document contains run - 4 shingles of the passage, or as many as
    the passage's least varied run has (``run_needs``): that is the
    containment threshold of the search, which is run for the items of each
    threshold. Candidates are verified by exact shingle containment and then
    by the rule itself: run - 4 shingles that follow each other in both
    texts, which are ``run`` words. Passages of fewer than ``run`` words
    can't meet the rule (``contained`` finds short ones), nor can null and
    empty texts; repeated documents are reported each.
    """
    docs, wanted = _sides(documents, items)
    span = run - SHINGLE + 1
    needs = materialize(wanted.join(run_needs(wanted, run), "id"), "needs")
    out = None
    for r in needs.groupBy("need").agg(F.max(_words("text")).alias("most")).orderBy("need").collect():
        found = matches(docs, needs.where(F.col("need") == r["need"]).select("id", "text"), r["need"], r["most"] - SHINGLE + 1)
        contains = found.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("_c")).where(F.col("_c") >= r["need"]).select("doc_id", "item_id")
        line = Window.partitionBy("doc_id", "item_id", F.col("j") - F.col("i")).orderBy("i").rangeBetween(0, span - 1)
        rows = found.join(contains, ["doc_id", "item_id"], "left_semi").withColumn("_k", F.count(F.lit(1)).over(line))
        part = rows.where(F.col("_k") == span).select("doc_id", "item_id").distinct()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _none(docs, wanted)


def _none(docs: DataFrame, items: DataFrame) -> DataFrame:
    kind = lambda t: t.schema["id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"doc_id {kind(docs)}, item_id {kind(items)}")


def contained(documents: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, containment: documents that hold ``share`` of the distinct shingles of an item's passage, however short.

    An item of fewer than five words is one shingle of its own length, and
    is sought among the documents' shingles of that length. Items without
    words are in no document. The search is run for items of like size, by
    powers of two, so that each has a threshold of its own.
    """
    docs, wanted = _sides(documents, items)
    sized = materialize(wanted.withColumn("n", _words("text")).where("n > 0"), "items")
    width = F.least(F.lit(SHINGLE), F.col("n"))
    band = F.floor(F.log2((F.col("n") - width + 1).cast("double"))).cast("int")
    out = None
    for r in sized.select(width.alias("w"), band.alias("b")).distinct().orderBy("w", "b").collect():
        own = sized.where((width == r["w"]) & (band == r["b"])).select("id", "text")
        sizes = shingles(own, r["w"]).groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("s").alias("_q"))
        need = max(1, math.ceil(share * sizes.agg(F.min("_q")).first()[0] - 1e-9))
        found = matches(docs, own, need, (2 << r["b"]) - 1, r["w"])
        shared = found.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("_c")).join(sizes, "item_id").withColumn("containment", F.col("_c") / F.col("_q"))
        part = shared.where(F.col("_c") >= F.col("_q") * share - 1e-9).select("doc_id", "item_id", "containment")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _none(docs, wanted).withColumn("containment", F.lit(0.0))
