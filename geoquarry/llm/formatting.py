"""Problem 5: duplicates hidden by formatting, by progressive partition refinement."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.storage import materialize

_OTHER = re.compile(r"[\W_]+")
#: Levels of refinement, cheapest first.
LEVELS = ("shape", "letters", "digest")


def _form(x) -> object:
    if isinstance(x, str):
        return ["s", _OTHER.sub("", x.lower())]
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return ["n", repr(int(x)) if x == x and abs(x) != float("inf") and x == int(x) else repr(x)]
    if isinstance(x, list):
        return ["l", [_form(y) for y in x]]
    return ["o", sorted((k, _form(v)) for k, v in x.items())]


def canonical(payload: str | None) -> str | None:
    """A text that two payloads share if and only if they hold the same record; null for what is not valid JSON.

    Keys are put in order. Strings become their letters and digits, lower
    case; numbers, booleans and null stand for their values, so that 1, 1.0
    and 1e0 are equal; lists and objects are compared part by part.
    """
    if payload is None:
        return None
    try:
        return json.dumps(_form(json.loads(payload)))
    except (ValueError, RecursionError, OverflowError):
        return None


def stripped(payload: str | None) -> tuple[int, str] | None:
    """Number of fields and the letters and digits of all top-level strings, lower case, in any order; null for what is not valid JSON.

    Both are the same for any two payloads that hold the same record.
    """
    if payload is None:
        return None
    try:
        x = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    values = x.values() if isinstance(x, dict) else x if isinstance(x, list) else (x,)
    strings = [v for v in values if isinstance(v, str)]
    return (len(values) << 1 | isinstance(x, dict)), _OTHER.sub("", "".join(strings).lower())


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _cheap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """raw_id, shape (fields, stripped length and sum of its bytes) and letters (histogram of letters and digits) of the valid lines."""
    for batch in batches:
        ids, shape, letters = [], [], []
        for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = stripped(p)
            if got is not None:
                fields, text = got
                ids.append(i)
                data = text.encode("utf-8", "surrogatepass")
                shape.append((fields << 48) + (len(data) << 24) + sum(data) & (1 << 62) - 1)
                letters.append(_hash("".join(sorted(text)).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shape, pa.int64()), pa.array(letters, pa.int64())], ["raw_id", "shape", "letters"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """raw_id and the digest of the whole record in canonical form."""
    for batch in batches:
        texts = [canonical(p) for p in batch.column(1).to_pylist()]
        digests = [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["raw_id", "digest"])


def refine(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The ``lines`` whose class by ``keys`` has several members, and no others.

    Classes are counted with partial aggregation; a class of very many lines
    meets its one row in a join that may be split.
    """
    several = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return lines.join(several, keys, "left_semi")


def survivors(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The valid lines of ``lines`` (raw_id, payload) with their cheap keys, and those that each level leaves in classes of several.

    First by shape, the number of fields, the stripped length and the sum of
    its bytes; inside such classes by the histogram of letters and digits; inside those that
    are still multiple by the digest of the parsed and normalised record,
    for which alone a payload is read again.
    """
    own = lines.select("raw_id", "payload")
    cheap = materialize(own.mapInArrow(_cheap, "raw_id bigint, shape bigint, letters bigint"), "cheap")
    shaped = refine(cheap, ["shape"])
    lettered = materialize(refine(shaped, ["shape", "letters"]).select("raw_id"), "lettered")
    digested = materialize(own.join(lettered, "raw_id", "left_semi").mapInArrow(_digests, "raw_id bigint, digest binary").where("digest is not null"), "digested")
    return cheap, shaped, lettered, digested


def copies(lines: DataFrame) -> DataFrame:
    """raw_id, first_id and n_copies of every line of ``lines`` (raw_id, payload) that is valid JSON.

    The lines are refined level by level (``survivors``). A line that falls
    alone at any level is its own first line.
    """
    cheap, _, lettered, digested = survivors(lines)
    classes = digested.groupBy("digest").agg(F.min("raw_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    single = cheap.join(lettered, "raw_id", "left_anti").select("raw_id", F.col("raw_id").alias("first_id"), F.lit(1).cast("long").alias("n_copies"))
    return digested.join(classes, "digest").select("raw_id", "first_id", "n_copies").unionByName(single)


def refinement(lines: DataFrame) -> DataFrame:
    """level, lines, survivors and classes: how many lines each level looks at, and how many it leaves in how many classes of several."""
    cheap, shaped, lettered, digested = survivors(lines)
    keys = {"shape": (cheap, ["shape"]), "letters": (shaped, ["shape", "letters"]), "digest": (digested, ["digest"])}
    out = None
    for level in LEVELS:
        rows, by = keys[level]
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        part = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("survivors"), F.count_if(F.col("_n") > 1).alias("classes")).select(F.lit(level).alias("level"), "lines", "survivors", "classes")
        out = part if out is None else out.unionByName(part)
    return out


def collapsed(lines: DataFrame) -> DataFrame:
    """The first line of each record with all its columns and ``n_copies``; lines that are not valid JSON are left out."""
    firsts = copies(lines).where("raw_id = first_id").select("first_id", "n_copies")
    own = lines.drop("first_id", "n_copies")
    return own.join(firsts, F.col("raw_id") == F.col("first_id")).drop("first_id")


def further_copies(lines: DataFrame) -> DataFrame:
    """first_id and copy_id: a row for each line that repeats an earlier one."""
    return copies(lines).where("raw_id <> first_id").select("first_id", F.col("raw_id").alias("copy_id"))
