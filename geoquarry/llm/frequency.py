"""Problem 1: occurrences and records of every n-gram of the values, from a suffix array with common-prefix intervals."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.functions.text import normal_form
from geoquarry.operators.ranking import running_in_hash_order
from geoquarry.storage import materialize

SEP, BEGIN, END = "\x1f", "\x02", "\x03"
#: Seed of the order in which distinct values and words are numbered.
SEED = 0


def _tokens() -> Column:
    """A value as the word sequence BEGIN w1 .. wn END."""
    return F.concat(F.array(F.lit(BEGIN)), F.split("v", " "), F.array(F.lit(END)))


def distinct_values(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their occurrences, and the rows of records that have several.

    First id, field, v, len (words with BEGIN and END), occ and ``alone``,
    the records that have this value only; then field, record and id. Values
    without words are left out. A null record is a record of its own kind and
    counts once.
    """
    rows = values.select("field", "record", normal_form(F.col("value")).alias("v")).where("v <> ''").groupBy("field", "record", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("field", "record"))), "values")
    texts = rows.groupBy("field", "v").agg(F.sum("n").alias("occ"), F.count_if(F.col("k") == 1).alias("alone"))
    texts = running_in_hash_order(materialize(texts, "distinct"), [], ["field", "v"], F.lit(1), SEED, "id")
    texts = materialize(texts.withColumn("len", F.size(_tokens())), "texts")
    several = rows.where("k > 1").join(texts.select("field", "v", "id"), ["field", "v"]).select("field", "record", "id")
    return texts, several


def suffix_ranks(texts: DataFrame) -> tuple[DataFrame, int]:
    """id, p, left, ranks and r of every suffix of the distinct values, and the number of levels.

    A suffix is what follows from word p on, ``left`` words with END. Its rank
    at level k is the number of suffixes whose first 2^k words come before its
    own; two suffixes have the same rank there just where these words are the
    same (or both are the same to their END). Level k + 1 orders the suffixes
    of one rank by the rank of what follows 2^k words later, so no suffix is
    ever written out and the work grows with words times the logarithm of a
    value's length. A value takes part while it is longer than 2^k; ``ranks``
    ends there, and ``r`` is the last of them. Words come in any fixed order.
    """
    each = texts.select("field", "id", "len", F.posexplode(_tokens()).alias("p", "w"))
    vocabulary = materialize(each.groupBy("field", "w").agg(F.count(F.lit(1)).alias("c")), "vocabulary")
    first = running_in_hash_order(vocabulary, [], ["field", "w"], F.col("c"), SEED, "r").select("field", "w", "r")
    state = each.join(first, ["field", "w"]).select("id", "p", (F.col("len") - F.col("p")).alias("left"), F.array("r").alias("ranks"), "r")
    state = materialize(state, "ranks")
    longest = texts.agg(F.max("len")).first()[0] or 1
    parts, h, levels = [], 1, 1
    while h < longest:
        parts.append(state.where(F.col("left") + F.col("p") <= h))
        after = F.lead("r", h).over(Window.partitionBy("id").orderBy("p"))
        keyed = state.where(F.col("left") + F.col("p") > h).withColumn("key", after)
        before = F.sum("c").over(Window.partitionBy("r").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        moved = keyed.where("key is not null").groupBy("r", "key").agg(F.count(F.lit(1)).alias("c")).select("r", "key", before.alias("moved")).where("moved > 0")
        state = keyed.join(moved, ["r", "key"], "left").withColumn("r", F.col("r") + F.coalesce("moved", F.lit(0)))
        state = materialize(state.select("id", "p", "left", F.concat("ranks", F.array("r")).alias("ranks"), "r"), "ranks")
        h, levels = 2 * h, levels + 1
    return reduce(DataFrame.unionByName, [*parts, state]), levels


def common_words(pairs: DataFrame, places: DataFrame, ranks: DataFrame, levels: int) -> DataFrame:
    """a, b and m: the number of words that the different suffixes of the ranks a and b have in common.

    ``places`` has a place id, p for each r. From the highest level at which the ranks agree, 2^k words
    are passed over and the rest compared at the levels below, so there are at most as many rounds as levels.
    """
    place = lambda r, x: places.select(F.col("r").alias(r), F.col("id").alias(f"{x}i"), F.col("p").alias(f"{x}p"))
    at = lambda x: ranks.select(F.col("id").alias(f"{x}i"), F.col("p").alias(f"{x}q"), F.col("ranks").alias(f"{x}r"))
    level = lambda x, k: F.col(x)[F.least(k, F.size(x) - 1)]
    state = pairs.select("a", "b").join(place("a", "x"), "a").join(place("b", "y"), "b").select("a", "b", "xi", F.col("xp").alias("xq"), "yi", F.col("yp").alias("yq"), F.lit(0).alias("m"), F.lit(levels).alias("k"))
    parts = []
    while True:
        both = state.join(at("x"), ["xi", "xq"]).join(at("y"), ["yi", "yq"])
        agree = F.size(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda k: level("xr", k) == level("yr", k))) - 1
        both = both.withColumn("k", agree).withColumn("step", F.when(F.col("k") < 0, 0).otherwise(F.expr("shiftleft(1, k)")))
        moved = [(F.col(c) + F.col("step")).alias(c) for c in ("xq", "yq", "m")]
        state = materialize(both.select("a", "b", "xi", "yi", *moved, "k"), "common")
        parts.append(state.where("k <= 0").select("a", "b", "m"))
        state = state.where("k > 0")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def record_neighbours(texts: DataFrame, several: DataFrame, ranks: DataFrame) -> DataFrame:
    """a, b and c: in c records the suffix of rank a follows that of rank b, or is the record's first (b null).

    Records with one value are counted together for that value; the others are put in order one by one.
    """
    at = ranks.where("left > 1").select("id", "r")
    many = several.join(at, "id").select("field", "record", F.lit(None).cast("long").alias("own"), "r", F.lit(1).cast("long").alias("c")).distinct()
    one = texts.where("alone > 0").select("id", "alone").join(at, "id").select(F.lit("").alias("field"), F.lit("").alias("record"), F.col("id").alias("own"), "r", F.col("alone").alias("c"))
    before = F.lag("r").over(Window.partitionBy("field", "record", "own").orderBy("r"))
    return materialize(many.unionByName(one).withColumn("b", before).groupBy(F.col("r").alias("a"), "b").agg(F.sum("c").alias("c")), "neighbours")


ITEM = "part bigint, seq int, lcp int, left int, id bigint, p int, occ bigint, rec bigint, at array<int>, less array<bigint>"
NOWHERE = (1 << 62, 0)


def _intervals(whole: bool):
    """Walks sorted suffixes and closes common-prefix intervals; the stack has an entry for each open one.

    Rows are of ``ITEM``: a suffix of ``left`` words shares ``lcp`` with the
    one before it, counts ``occ`` and ``rec``, and takes ``less`` records off
    the n-grams of up to ``at`` words. Closed intervals come out with seq -1
    and their shortest and longest n-gram as lcp and left. Unless the rows are
    ``whole``, intervals that may go on before the first row or after the
    last come out as rows for a second walk over all parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length: list[int] = []
        entry: list[list] = []  # occurrences, records, first place
        out: list[tuple] = []
        pending: list[tuple[int, int]] = []
        part, seq = None, 0

        def close(to: int) -> None:
            while length[-1] > to:
                n, (o, r, place) = length.pop(), entry.pop()
                out.append((part, -1, max(length[-1], to) + 1, n, *place, o, r, [], []))
                if length[-1] < to:
                    length.append(to), entry.append([o, r, place])
                else:
                    under = entry[-1]
                    under[0] += o
                    under[1] += r
                    under[2] = min(under[2], place)

        def leave(lcp: int, n: int, o: int, r: int, place: tuple, taken: list) -> None:
            nonlocal seq
            out.append((part, seq, lcp, n, *place, o, r, [s for s, _ in taken], [c for _, c in taken]))
            seq += 1

        for batch in batches:
            for row in batch.itertuples(index=False):
                lcp, n, place = int(row.lcp), int(row.left), (int(row.id), int(row.p))
                if not length:
                    part = int(row.part)
                    length.append(0 if whole else lcp), entry.append([0, 0, NOWHERE])
                if lcp < length[0]:  # what shares more with the rows before this part ends here
                    close(length[0])
                    leave(length[0], length[0], *entry[0], pending)
                    pending = []
                    length[0], entry[0] = lcp, [0, 0, NOWHERE]
                close(lcp)
                if n > length[-1]:
                    length.append(n), entry.append([int(row.occ), int(row.rec), place])
                else:
                    entry[-1] = [entry[-1][0] + int(row.occ), entry[-1][1] + int(row.rec), min(entry[-1][2], place)]
                for s, c in zip(map(int, row.at), map(int, row.less)):
                    if s < length[0]:
                        pending.append((s, c))
                    else:
                        entry[bisect_left(length, s)][1] -= c
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEM.split(", ")])
            out.clear()
        if length and whole:
            close(0)
        elif length:
            leave(length[0], length[0], *entry[0], pending)
            for below, n, e in zip(length, length[1:], entry[1:]):
                leave(below, n, *e, [])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEM.split(", ")])

    return run


def ngram_runs(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences and records of all n-grams of ``values`` (field, record, value), of any length.

    First id, p, shortest, longest, occurrences and records: the n-grams of
    shortest to longest words that begin at word p of the distinct value id
    occur in the same places, so they have the same numbers; every n-gram is
    in one such run, and there are at most two for each word. p is the first
    such place. Then the distinct values (``distinct_values``).

    Suffixes are ranked, each is compared with the one before it, and one walk
    closes the intervals. Those of a record are put in order as well; where
    two share m words, one record is taken off every n-gram of up to m words.
    The suffixes are cut by range over the cluster; intervals that a border
    cuts are closed by a walk over the parts' open ends.
    """
    spark = values.sparkSession
    texts, several = distinct_values(values)
    ranks, levels = suffix_ranks(texts)
    classes = ranks.where("left > 1").join(texts.select("id", "occ"), "id").groupBy("r").agg(F.count(F.lit(1)).alias("c"), F.sum("occ").alias("occ"), F.min(F.struct("id", "p", "left")).alias("s"))
    classes = materialize(classes.select("r", "c", "occ", "s.*"), "classes")
    # A rank is a number of suffixes, so the next is this one and the suffixes that have it.
    follow = classes.select((F.col("r") + F.col("c")).alias("a"), F.col("r").alias("b")).join(classes.select(F.col("r").alias("a")), "a")
    inside = record_neighbours(texts, several, ranks)
    pairs = follow.select("a", "b").unionByName(inside.where("b is not null").select("a", "b")).distinct()
    common = common_words(pairs, classes, ranks, levels)
    taken = inside.join(common, ["a", "b"]).groupBy("a", "m").agg(F.sum("c").alias("c")).groupBy("a").agg(F.collect_list(F.struct("m", "c")).alias("l"))
    taken = taken.select(F.col("a").alias("r"), F.col("l.m").alias("at"), F.col("l.c").alias("less"))
    records = inside.groupBy(F.col("a").alias("r")).agg(F.sum("c").alias("rec"))
    shared = follow.join(common, ["a", "b"]).select(F.col("a").alias("r"), F.col("m").alias("lcp"))
    items = classes.join(records, "r").join(shared, "r", "left").join(taken, "r", "left")
    none = {"lcp": F.lit(0), "at": F.array().cast("array<int>"), "less": F.array().cast("array<bigint>")}
    items = items.select(F.col("r").alias("part"), F.lit(0).alias("seq"), *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in "lcp left id p occ rec at less".split()])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    walked = materialize(items.repartitionByRange(parts, "part").sortWithinPartitions("part").mapInPandas(_intervals(False), ITEM), "walked")
    ends = walked.where("seq >= 0").repartition(1).sortWithinPartitions("part", "seq").mapInPandas(_intervals(True), ITEM)
    runs = walked.where("seq < 0").unionByName(ends)
    return materialize(runs.select("id", "p", F.col("lcp").alias("shortest"), F.col("left").alias("longest"), F.col("occ").alias("occurrences"), F.col("rec").alias("records")), "runs"), texts


def ngram_frequencies(values: DataFrame, longest: int) -> DataFrame:
    """field, ngram, n, occurrences and records of all n-grams of up to ``longest`` words, and of all whole values (BEGIN .. END)."""
    runs, texts = ngram_runs(values)
    starts = F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: F.slice("t", i, longest))
    words = texts.withColumn("t", _tokens()).select("field", "id", "len", F.posexplode(starts).alias("p", "s"))
    short = runs.where(F.col("shortest") <= longest).join(words, ["id", "p"])
    lengths = F.explode(F.sequence("shortest", F.least("longest", F.lit(longest)))).alias("n")
    short = short.select("field", "s", lengths, "occurrences", "records").select("field", F.array_join(F.slice("s", F.lit(1), F.col("n")), SEP).alias("ngram"), "n", "occurrences", "records")
    whole = _whole(runs, texts).where(F.col("len") > longest)
    return short.unionByName(whole.select("field", F.array_join(_tokens(), SEP).alias("ngram"), F.col("len").alias("n"), "occurrences", "records"))


def _whole(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """The runs that end with a whole value."""
    return runs.where("p = 0").join(texts, "id").where(F.col("longest") == F.col("len"))


def word_runs(values: DataFrame) -> DataFrame:
    """field, value, start, shortest, longest, occurrences and records of all n-grams inside the values, of any length.

    A row stands for the n-grams of shortest to longest words from word
    ``start`` (the first is 1) on of the value whose normal form has the MD5
    digest ``value``: all occur in the same places. An n-gram is in one row.
    """
    runs, texts = ngram_runs(values)
    found = runs.where("p > 0").join(texts.select("field", "id", "len", F.md5(F.encode("v", "utf-8")).alias("value")), "id")
    found = found.withColumn("longest", F.least("longest", F.col("len") - F.col("p") - 1)).where("shortest <= longest")
    return found.select("field", "value", F.col("p").alias("start"), "shortest", "longest", "occurrences", "records")


def word_ngrams(values: DataFrame, longest: int = 5) -> DataFrame:
    """field, ngram, n, occurrences and records of every n-gram of up to ``longest`` words inside the values (field, record, value)."""
    grams = ngram_frequencies(values, longest)
    inside = ~F.col("ngram").contains(BEGIN) & ~F.col("ngram").contains(END)
    return grams.where(inside).withColumn("ngram", F.replace("ngram", F.lit(SEP), F.lit(" ")))


def value_frequencies(values: DataFrame, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """field, term, occurrences, records and mark of every distinct value of ``values`` (field, record, value).

    ``mark`` is ``rare`` below ``rare_below`` records, else ``common`` above
    ``common_above`` of the field's records that have a value, else null. A
    term is the normal form of a value; nulls, blanks and wordless values
    have none. An empty table gives an empty result.
    """
    runs, texts = ngram_runs(values)
    # Every value has the empty beginning, BEGIN.
    totals = runs.where("p = 0 and shortest = 1").join(texts.select("id", F.col("field").alias("_f")), "id").select("_f", F.col("records").alias("_all"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("_all") * common_above, "common")
    return _whole(runs, texts).join(totals, F.col("field") == F.col("_f")).select("field", F.col("v").alias("term"), "occurrences", "records", mark.alias("mark"))
