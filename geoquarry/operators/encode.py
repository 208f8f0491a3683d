"""Rendering, tokenizing, truncating, packing and collating training rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.operators.kernels import knapsacks

IGNORE = -100
VOCABULARY = 50_000


def token_ids(text: Column, vocabulary: int = VOCABULARY) -> Column:
    """Ids of a text under the deterministic stand-in tokenizer: words and single marks, each the first seven hex digits of its md5, modulo the vocabulary.

    It matches no real vocabulary; a real tokenizer may be given to the
    encoders instead, as any function from a text Column to an id array.
    """
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))
    return F.transform(parts, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % vocabulary).cast("int"))


def budget(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """Source and target lengths that fit ``cutoff``: a short target is kept whole, a short source too, otherwise in proportion."""
    c = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    most = F.when(target * 2 < c, c).when(source * 2 < c, c - source).otherwise(F.floor(c * (target / F.nullif(source + target, F.lit(0)))))
    kept = F.least(most.cast("int"), target)
    return F.least(F.greatest(c - kept, F.lit(0)), source).cast("int"), kept.cast("int")


def pairs(prompt: Column, response: Column) -> Column:
    """Turns of prompt and response as (source, target) texts."""
    turns = F.concat(prompt, response)
    n = F.floor(F.size(turns) / 2).cast("int")
    both = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(turns[i * 2]["content"].alias("source"), turns[i * 2 + 1]["content"].alias("target")))
    return F.when(n > 0, both).otherwise(F.array().cast("array<struct<source:string,target:string>>"))


def encode_turns(turns: Column, tokenize: Callable[[Column], Column] = token_ids) -> Column:
    """(source, target) texts as ids."""
    return F.transform(turns, lambda t: F.struct(tokenize(t["source"]).alias("s"), tokenize(t["target"]).alias("t")))


def sft(encoded: Column, cutoff: int, eos: int = 1, train_on_prompt: bool = False, mask_history: bool = False, efficient_eos: bool = False) -> Column:
    """input_ids and labels of encoded turns under a running budget.

    Each turn gets what the turns before left of ``cutoff``, shared out by
    ``budget``; the fold ends when nothing is left. Sources are masked unless
    trained on. With ``mask_history`` turns are taken from the last back, and
    only the last is learned. ``efficient_eos`` ends the row once.
    """
    limit = cutoff - (1 if efficient_eos else 0)
    order = F.reverse(encoded) if mask_history else encoded
    numbered = F.transform(order, lambda t, i: F.struct(t["s"].alias("s"), t["t"].alias("t"), i.alias("i")))
    ints = "array<int>"
    start = F.struct(F.array().cast(ints).alias("ids"), F.array().cast(ints).alias("labels"))

    def step(a: Column, t: Column) -> Column:
        left = F.lit(limit) - F.size(a["ids"])
        n_s, n_t = budget(F.size(t["s"]), F.size(t["t"]), left)
        s, y = F.slice(t["s"], F.lit(1), n_s), F.slice(t["t"], F.lit(1), n_t)
        masked = F.array_repeat(F.lit(IGNORE), n_s)
        s_labels = s if train_on_prompt else masked
        y_labels = F.when(t["i"] == 0, y).otherwise(F.array_repeat(F.lit(IGNORE), n_t)) if mask_history else y
        if mask_history and train_on_prompt:
            s_labels = F.when(t["i"] == 0, s).otherwise(masked)
        ids, labels = F.concat(s, y), F.concat(s_labels, y_labels)
        grown = F.struct(*[(F.concat(new, a[c]) if mask_history else F.concat(a[c], new)).alias(c) for c, new in (("ids", ids), ("labels", labels))])
        return F.when(left <= 0, a).otherwise(grown)

    done = F.aggregate(numbered, start, step)
    if not efficient_eos:
        return done
    end = F.array(F.lit(eos))
    return F.struct(F.concat(done["ids"], end).alias("ids"), F.concat(done["labels"], end).alias("labels"))


def sft_rows(aligned: DataFrame, key: str, cutoff: int, **options) -> DataFrame:
    """Aligned rows as key, input_ids, attention_mask and labels; broken rows are dropped."""
    from geoquarry.operators.align import valid

    e = valid(aligned, "sft").select(key, sft(encode_turns(pairs(F.col("_prompt"), F.col("_response"))), cutoff, **options).alias("e"))
    return e.select(key, F.col("e.ids").alias("input_ids"), F.array_repeat(F.lit(1), F.size("e.ids")).alias("attention_mask"), F.col("e.labels").alias("labels"))


def pairwise(prompt: Column, chosen: Column, rejected: Column, cutoff: int, eos: int = 1) -> dict[str, Column]:
    """Ids and labels of both sides of a preference; both share the prompt, cut for the longer answer."""
    c, r = F.concat(chosen, F.array(F.lit(eos))), F.concat(rejected, F.array(F.lit(eos)))
    n_s, n_t = budget(F.size(prompt), F.greatest(F.size(c), F.size(r)), cutoff)
    s = F.slice(prompt, F.lit(1), n_s)
    mask = F.array_repeat(F.lit(IGNORE), F.size(s))
    cut = lambda x: F.slice(x, F.lit(1), n_t)
    return {"chosen_input_ids": F.concat(s, cut(c)), "chosen_labels": F.concat(mask, cut(c)), "rejected_input_ids": F.concat(s, cut(r)), "rejected_labels": F.concat(mask, cut(r))}


def feedback(prompt: Column, response: Column, kl: Column, desired: Column, cutoff: int, eos: int = 1) -> dict[str, Column]:
    """Ids and labels of an answer and of its mismatched partner, and whether the answer is wanted."""
    out: dict[str, Column] = {"kto_tags": desired}
    for prefix, answer in (("", response), ("kl_", kl)):
        t = F.concat(answer, F.array(F.lit(eos)))
        n_s, n_t = budget(F.size(prompt), F.size(t), cutoff)
        s, y = F.slice(prompt, F.lit(1), n_s), F.slice(t, F.lit(1), n_t)
        out |= {f"{prefix}input_ids": F.concat(s, y), f"{prefix}labels": F.concat(F.array_repeat(F.lit(IGNORE), n_s), y)}
    return out


def unsupervised(prompt: Column, response: Column, cutoff: int, eos: int = 1) -> dict[str, Column]:
    """The prompt as input, the answer as labels."""
    t = F.concat(response, F.array(F.lit(eos)))
    n_s, n_t = budget(F.size(prompt), F.size(t), cutoff)
    return {"input_ids": F.slice(prompt, F.lit(1), n_s), "labels": F.slice(t, F.lit(1), n_t)}


def batches(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Adds ``batch_id``: rows in the order of a key, ``size`` to a batch; batch-local operators work inside it."""
    from geoquarry.operators.mix import numbered

    return numbered(df, key).withColumn("batch_id", F.floor(F.col("row_no") / size)).drop("row_no")


def pretrain_chunks(tokens: DataFrame, batch: str, key: str, ids: str, block: int) -> DataFrame:
    """Concatenates the ids of each batch and cuts them into full blocks; what remains of a batch is dropped.

    Only lengths are summed up in order; ids are then cut where they are, so
    that a block is gathered from the few rows it touches.
    """
    before = Window.partitionBy(batch).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.select(batch, key, ids).where(F.size(ids) > 0).withColumn("_at", F.coalesce(F.sum(F.size(ids)).over(before), F.lit(0)))
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.size(ids) - 1) / block)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block - F.col("_at"), F.lit(0)).cast("int")
    end = F.least((F.col("block") + 1) * block - F.col("_at"), F.size(ids)).cast("int")
    part = F.struct("_at", F.slice(ids, begin + 1, end - begin).alias("p"))
    return cut.groupBy(batch, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"])).alias("input_ids")).where(F.size("input_ids") == block)


def pretrain_rows(text: Column, cutoff: int, eos: int = 1, tokenize: Callable[[Column], Column] = token_ids) -> Column:
    return F.slice(F.concat(tokenize(text), F.array(F.lit(eos))), 1, cutoff)


def pack(rows: DataFrame, batch: str, key: str, cutoff: int, neat: bool = True, pad: int = 0) -> DataFrame:
    """Packs rows (batch, key, input_ids, labels) of each batch into sequences of ``cutoff`` + 1 by knapsack.

    Rows longer than ``cutoff`` are dropped. With ``neat`` the attention mask
    numbers the rows of a pack from 1, without it is 1; padding is 0.
    Positions begin again in every row. ``keys`` lists the packed rows.
    """
    total = cutoff + 1
    kind = rows.schema[key].dataType.simpleString()
    name = rows.schema[batch].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key).reset_index(drop=True)
        lengths = [len(x) for x in group["input_ids"]]
        out = []
        for i, chosen in enumerate(knapsacks(lengths, cutoff)):
            ids, labels, mask, places = [], [], [], []
            for n, j in enumerate(chosen, 1):
                ids += list(group["input_ids"][j])
                labels += list(group["labels"][j])
                mask += [n if neat else 1] * lengths[j]
                places += range(lengths[j])
            gap = total - len(ids)
            out.append((group[batch][0], i, ids + [pad] * gap, labels + [IGNORE] * gap, mask + [0 if neat else 1] * gap, places + [0] * gap, [group[key][j] for j in chosen]))
        return pd.DataFrame(out, columns=[batch, "pack", "input_ids", "labels", "attention_mask", "position_ids", "keys"])

    schema = f"{batch} {name}, pack int, input_ids array<int>, labels array<int>, attention_mask array<int>, position_ids array<int>, keys array<{kind}>"
    return rows.select(batch, key, "input_ids", "labels").groupBy(batch).applyInPandas(run, schema)


def sequence_lengths(mask: Column) -> Column:
    """Lengths of the numbered segments of a mask, in order; padding (0) is left out."""
    numbers = F.array_sort(F.array_distinct(F.filter(mask, lambda x: x != 0)))
    return F.transform(numbers, lambda k: F.size(F.filter(mask, lambda x: x == k)))


def offsets(lengths: Column) -> Column:
    """Sums of lengths from 0 on."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))


def unpadded(mask: Column) -> Column:
    """Places of a mask that are not padding."""
    return F.filter(F.transform(mask, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def block_causal(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """Allowed (query, key) places of each row: same segment, not padding, not ahead."""
    q = rows.select(key, mask, F.posexplode(mask).alias("i", "_m")).where("_m <> 0")
    return q.select(key, "i", F.posexplode(F.slice(mask, F.lit(1), F.col("i") + 1)).alias("j", "_n"), "_m").where("_n = _m").select(key, "i", "j")


def packed_positions(lengths: Column) -> Column:
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))


def split_media(media: Column, counts: Column) -> Column:
    """A flat list as lists of given lengths."""
    starts = F.transform(F.slice(offsets(counts), F.lit(1), F.size(counts)), lambda x: x)
    return F.transform(F.arrays_zip(starts.alias("s"), counts.alias("n")), lambda p: F.slice(media, p["s"] + 1, p["n"]))


def token_types(ids: Column, image_token: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == image_token, 1).otherwise(0))


def expand_placeholders(text: Column, mark: str, counts: Column, begin: str, token: str, end: str) -> Column:
    """Replaces the k-th ``mark`` by begin, ``counts[k]`` tokens and end; marks without a count stay."""
    parts = F.split(text, mark.replace("|", r"\|").replace("[", r"\["), -1)
    piece = lambda i: F.when(i < F.size(counts), F.concat(F.lit(begin), F.repeat(F.lit(token), F.element_at(counts, i + 1)), F.lit(end))).otherwise(F.lit(mark))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(piece((i - 1).cast("int")), p))), "")


MEDIA_EXPANDERS: dict[str, tuple[str, str, str]] = {"qwen2_vl": ("<|vision_start|>", "<|image_pad|>", "<|vision_end|>"), "plain": ("", "<image>", "")}


def register_expander(name: str, begin: str, token: str, end: str) -> None:
    if name in MEDIA_EXPANDERS:
        raise ValueError(f"media expander {name} exists already")
    MEDIA_EXPANDERS[name] = (begin, token, end)


def processor(stage: str, packing: bool = False, generate: bool = False) -> str:
    """Which encoder a stage takes."""
    if stage == "pt":
        return "pretrain"
    if stage == "sft" and not generate:
        return "packed_sft" if packing else "sft"
    return {"rm": "pairwise", "kto": "feedback"}.get(stage, "unsupervised")


def check_arguments(*, stage: str, cutoff: int, packing: bool = False, neat_packing: bool = False, streaming: bool = False, max_samples: int | None = None, val_size: float = 0, eval_dataset: list[str] | None = None, mix_strategy: str = "concat", weights: list[float] | None = None, datasets: list[str] | None = None, mask_history: bool = False, train_on_prompt: bool = False) -> dict:
    """Checks options against each other before anything is planned; returns packing and cutoff as they take effect."""
    if val_size > 1e-6 and eval_dataset:
        raise ValueError("val_size and eval_dataset exclude each other")
    if mix_strategy == "concat" and weights is not None:
        raise ValueError("weights need interleaving")
    if weights is not None and len(weights) != len(datasets or ()):
        raise ValueError("one weight for each data set")
    if streaming and 1e-6 < val_size < 1:
        raise ValueError("streaming needs a whole number for val_size")
    if streaming and max_samples is not None:
        raise ValueError("streaming and max_samples exclude each other")
    if mask_history and train_on_prompt:
        raise ValueError("mask_history and train_on_prompt exclude each other")
    packing = packing or neat_packing or stage == "pt"
    return {"packing": packing, "cutoff": cutoff - 1 if packing else cutoff}


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)
