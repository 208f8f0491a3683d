"""Problem 8: encoding texts with a public byte-level BPE tokenizer, by a segment tree over pair ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: the pattern by which the public tokenizer splits a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; a bound on memory, without influence on results.
REMEMBERED = 200_000


def load_ranks(folder: str = FOLDER, name: str = NAME) -> dict[bytes, int]:
    """Token bytes to rank, which is also the token's id."""
    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, merged pair by pair, always the leftmost pair of the lowest rank.

    The leaves of a segment tree hold the rank of each pair of neighbours at
    the place of its left part; an inner node holds the lesser of its
    children, the left one on a tie, so the root names the next merge. A
    merge changes three leaves, each updated on one path to the root: n parts
    take n log n steps, for a piece of any length.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = len(ranks) + 1
    get = ranks.get
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    right = [*range(1, n), -1]
    left = [*range(-1, n - 1)]
    base = 1 << (n - 1).bit_length()
    # A node's value orders by rank, then by place.
    shift = base.bit_length()
    top = none << shift
    tree = [top] * (2 * base)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[base + i] = r << shift | i
    for k in range(base - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, value: int) -> None:
        k = base + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    mask = (1 << shift) - 1
    while tree[1] < top:
        i = tree[1] & mask
        j = right[i]
        parts[i] += parts[j]
        parts[j] = b""
        put(j, top)
        k = right[j]
        right[i] = k
        if k >= 0:
            left[k] = i
            r = get(parts[i] + parts[k])
            put(i, top if r is None else r << shift | i)
        else:
            put(i, top)
        h = left[i]
        if h >= 0:
            r = get(parts[h] + parts[i])
            put(h, top if r is None else r << shift | h)
    return [ranks[p] for p in parts if p]


class Encoder:
    """Texts to ids; what it remembers of pieces is bounded."""

    def __init__(self, folder: str = FOLDER, name: str = NAME) -> None:
        import regex

        self.ranks = load_ranks(folder, name)
        self.split = regex.compile(PIECES).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int] | None:
        if text is None:
            return None
        ids: list[int] = []
        known, extend = self.known, ids.extend
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = got
            extend(got)
        return ids


def encode(texts: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key`` and ``ids`` of every row: whole texts, no special tokens, their strings being ordinary text.

    Null gives null, an empty text an empty array, a blank text the ids of
    its blanks. Rows are independent; nothing is shuffled. The tokenizer's
    file is read where a task runs, from ``folder``.
    """
    rows = texts.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, name)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = pa.array([encoder(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")
