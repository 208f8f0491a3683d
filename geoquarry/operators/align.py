"""Alignment of alpaca, sharegpt and openai rows to one nested schema, and the filters on it.

Aligned rows have ``_prompt`` and ``_response``, arrays of (role, content),
``_system``, ``_tools`` and media columns. Rows that break a format's rules
keep their key and get empty arrays, so that a later filter drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.sources.registry import TAGS

MESSAGES = "array<struct<role:string,content:string>>"
USER, ASSISTANT, SYSTEM, FUNCTION, OBSERVATION = "user", "assistant", "system", "function", "observation"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def nothing() -> Column:
    return F.array().cast(MESSAGES)


def media(column: Column) -> Column:
    """Media paths: an empty list is absent."""
    return F.when(F.size(column) > 0, column)


def alpaca(prompt: Column, query: Column | None = None, response: Column | None = None, history: Column | None = None, kto: Column | None = None, chosen: Column | None = None, rejected: Column | None = None) -> tuple[Column, Column]:
    """Prompt and response of an alpaca row.

    History pairs become turns; the last user turn joins the non-empty of
    prompt and query by a line break. The response is a feedback pair where
    ``kto`` is set, a ranked pair where both sides are, else one turn, else
    nothing.
    """
    blank = lambda c: F.when(F.length(c) > 0, c)
    content = F.concat_ws("\n", *[blank(c) for c in (prompt, query) if c is not None])
    turns = F.array(message(USER, content)).cast(MESSAGES)
    if history is not None:
        past = F.flatten(F.transform(history, lambda h: F.array(message(USER, h[0]), message(ASSISTANT, h[1]))))
        turns = F.concat(F.coalesce(past.cast(MESSAGES), nothing()), turns)
    said = F.array(message(ASSISTANT, response)).cast(MESSAGES) if response is not None else nothing()
    empty = message(ASSISTANT, F.lit(""))
    answer = F.when(response.isNotNull(), said).otherwise(nothing()) if response is not None else nothing()
    if chosen is not None and rejected is not None:
        answer = F.when(chosen.isNotNull() & rejected.isNotNull(), F.array(message(ASSISTANT, chosen), message(ASSISTANT, rejected)).cast(MESSAGES)).otherwise(answer)
    if kto is not None and response is not None:
        good = F.array(message(ASSISTANT, response), empty).cast(MESSAGES)
        bad = F.array(empty, message(ASSISTANT, response)).cast(MESSAGES)
        answer = F.when(kto.isNotNull(), F.when(kto, good).otherwise(bad)).otherwise(answer)
    return turns, answer


def _roles(tags: dict[str, str], role: Column) -> Column:
    """The role of a turn by its tag, null for an unknown one."""
    out = F.lit(None).cast("string")
    for name in (USER, ASSISTANT, OBSERVATION, FUNCTION, SYSTEM):
        out = F.when(role == tags[name], name).otherwise(out)
    return out


def chat(messages: Column, tags: dict[str, str], system: Column | None = None, ranking: bool = False, kto: Column | None = None, chosen: Column | None = None, rejected: Column | None = None) -> tuple[Column, Column, Column]:
    """Prompt, response and system of a chat row.

    A leading system turn is taken off. Turns at even places must be user or
    observation, at odd places assistant or function, and their number even,
    or odd for ranked rows; otherwise both arrays are empty.
    """
    role_of = lambda m: m[tags["role"]]
    first = (F.size(messages) > 0) & (role_of(messages[0]) == tags[SYSTEM])
    lead = F.when(first, messages[0][tags["content"]])
    body = F.coalesce(F.when(first, F.slice(messages, 2, F.size(messages))).otherwise(messages))
    fits = F.forall(
        F.transform(body, lambda m, i: F.when(i % 2 == 0, role_of(m).isin(tags[USER], tags[OBSERVATION])).otherwise(role_of(m).isin(tags[ASSISTANT], tags[FUNCTION]))),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    parity = F.size(body) % 2 == (1 if ranking else 0)
    valid = F.coalesce(fits & parity & (F.size(body) > 0), F.lit(False))
    turns = F.transform(body, lambda m: message(_roles(tags, role_of(m)), m[tags["content"]])).cast(MESSAGES)
    n = F.size(turns)
    if ranking:
        assert chosen is not None and rejected is not None
        sides = F.transform(F.array(chosen, rejected), lambda m: message(_roles(tags, role_of(m)), m[tags["content"]])).cast(MESSAGES)
        known = F.forall(F.array(chosen, rejected), lambda m: F.coalesce(role_of(m).isin(tags[ASSISTANT], tags[FUNCTION]), F.lit(False)))
        prompt, response, valid = turns, sides, valid & known
    else:
        prompt, response = F.slice(turns, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(turns, F.greatest(n, F.lit(1)), F.lit(1))
        if kto is not None:
            last, empty = turns[n - 1], message(ASSISTANT, F.lit(""))
            response = F.when(kto.isNull(), response).when(kto, F.array(last, empty).cast(MESSAGES)).otherwise(F.array(empty, last).cast(MESSAGES))
    given = F.coalesce(lead, system) if system is not None else lead
    return F.when(valid, prompt).otherwise(nothing()), F.when(valid, response).otherwise(nothing()), F.coalesce(given, F.lit(""))


def sharegpt(messages: Column, **kwargs) -> tuple[Column, Column, Column]:
    """``chat`` with the default tags of sharegpt rows, or those given as ``tags``."""
    return chat(messages, kwargs.pop("tags", TAGS["sharegpt"]), **kwargs)


#: Fixed value: what stands between tool results that answer one call.
TOOL_JOINT = "\n</tool_response>\n<tool_response>\n"


def merged_tools(messages: Column) -> Column:
    """Openai turns with calls as function turns and runs of tool results merged into one; results at the end are dropped.

    ``messages`` is an array of (role, content, tool_calls as JSON text or
    null). A fold keeps the finished turns and the results still open.
    """
    state = "struct<done:array<struct<role:string,content:string>>,open:array<string>>"
    flush = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(message("tool", F.array_join(s["open"], TOOL_JOINT))))).otherwise(s["done"])
    keep = lambda done, opened: F.struct(done.cast(MESSAGES).alias("done"), opened.cast("array<string>").alias("open"))

    def step(s: Column, m: Column) -> Column:
        call = F.when(m["tool_calls"].isNotNull() & (F.length(m["tool_calls"]) > 2), message("function", m["tool_calls"])).otherwise(message(m["role"], m["content"]))
        return F.when(m["role"] == "tool", keep(s["done"], F.concat(s["open"], F.array(m["content"])))).otherwise(keep(F.concat(flush(s), F.array(call)), F.array()))

    start = F.struct(nothing().alias("done"), F.array().cast("array<string>").alias("open")).cast(state)
    return F.aggregate(messages, start, step, lambda s: s["done"])


def openai(messages: Column, tools: Column | None = None, **kwargs) -> tuple[Column, Column, Column]:
    """``chat`` over ``merged_tools``; a system text without tools gets the mark that turns detailed thinking off."""
    prompt, response, system = chat(merged_tools(messages), {**TAGS["openai"]}, **kwargs)
    without = F.lit(True) if tools is None else (tools.isNull() | (F.length(tools) == 0))
    marked = F.when(without & (F.length(system) > 0), F.concat(system, F.lit("\n\ndetailed thinking off"))).otherwise(system)
    return prompt, response, marked


def v1_alpaca(instruction: Column, query: Column, output: Column, system: Column | None = None) -> Column:
    """Messages of typed parts with loss weights: instruction and input run together, only the answer is learned."""

    def turn(role: str, text: Column, weight: float) -> Column:
        part = F.array(F.struct(F.lit("text").alias("type"), text.alias("value")))
        return F.when(F.length(text) > 0, F.struct(F.lit(role).alias("role"), part.alias("content"), F.lit(weight).alias("loss_weight")))

    asked = F.concat(F.coalesce(instruction, F.lit("")), F.coalesce(query, F.lit("")))
    turns = [turn(USER, asked, 0.0), turn(ASSISTANT, output, 1.0)]
    return F.array_compact(F.array(*([turn(SYSTEM, system, 0.0)] if system is not None else []), *turns))


CONVERTERS = {"alpaca": alpaca, "sharegpt": sharegpt, "openai": openai}


def register_converter(name: str, converter) -> None:
    """Adds a converter of Columns under a new name."""
    if name in CONVERTERS:
        raise ValueError(f"converter {name} exists already")
    CONVERTERS[name] = converter


def converter(name: str):
    try:
        return CONVERTERS[name]
    except KeyError:
        raise ValueError(f"no converter {name}") from None


def valid(df: DataFrame, stage: str = "sft") -> DataFrame:
    """Rows fit for a stage: an odd prompt, and one response for sft, two or more for rm and kto, any for pt and ppo."""
    odd = F.size("_prompt") % 2 == 1
    n = F.size("_response")
    return df.where({"sft": odd & (n == 1), "rm": odd & (n >= 2), "kto": odd & (n >= 2)}.get(stage, odd))


def mismatched(df: DataFrame, batch: str, order: str) -> DataFrame:
    """Adds ``kl_response``: the response of the row before in the batch, of the last row for the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(batch).orderBy(order)
    last = F.last("_response").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("kl_response", F.coalesce(F.lag("_response").over(w), last))


def placeholders(text: Column, mark: str) -> Column:
    """How often ``mark`` stands in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def placeholder_check(messages: Column, images: Column, videos: Column | None = None, audios: Column | None = None) -> Column:
    """Why a row's placeholders don't fit its media, or null if they do."""
    text = F.array_join(F.transform(messages, lambda m: m["content"]), "")
    out = F.lit(None).cast("string")
    for name, column in (("audio", audios), ("video", videos), ("image", images)):
        have = F.lit(0) if column is None else F.coalesce(F.when(column.isNotNull(), F.size(column)), F.lit(0))
        out = F.when(placeholders(text, f"<{name}>") != have, F.lit(f"{name} placeholders")).otherwise(out)
    return out


def request_check(messages: Column) -> Column:
    """Why a chat request must be rejected, or null: it needs turns, an odd number after an optional system turn, and roles that alternate."""
    first = F.coalesce((F.size(messages) > 0) & (messages[0]["role"] == SYSTEM), F.lit(False))
    body = F.when(first, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    fits = F.forall(
        F.transform(body, lambda m, i: F.when(i % 2 == 0, m["role"].isin(USER, "tool")).otherwise(m["role"].isin(ASSISTANT, FUNCTION))), lambda ok: F.coalesce(ok, F.lit(False))
    )
    return F.when(F.coalesce(F.size(messages), F.lit(0)) == 0, "invalid length").when(F.size(body) % 2 == 0, "only supports u/a/u/a/u").when(~fits, "invalid role")


def safe_path(path: Column, folder: str) -> Column:
    """Whether a path stays inside ``folder``: absolute below it, and without steps upwards."""
    return path.startswith(folder.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def safe_url(url: Column) -> Column:
    """Whether a URL is http(s) and names no loopback, private or link-local address."""
    host = F.try_parse_url(url, F.lit("HOST"))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[?::1|\[?f[cd])")
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host.isNotNull() & ~private, F.lit(False))


# The task text of a question and its suffixes.
VQA_TASK = "Task: Answer the following question about the image.\nQuestion: {}\nReturn only the final answer."
VQA_INTEGER, VQA_CATEGORY = "\nAnswer with one integer only.", "\nAnswer with one category label only."


def vqa_prompt(question: Column, kind: Column) -> Column:
    """Prompt of a question, with suffixes for quantities and for categories; a null question leaves its place empty."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    suffix = lambda word, text: F.when(low.contains(word), text).otherwise("")
    before, after = VQA_TASK.split("{}")
    return F.concat(F.lit(before), F.coalesce(question, F.lit("")), F.lit(after), suffix("quantity", VQA_INTEGER), suffix("category", VQA_CATEGORY))


def vqa_record(image: Column, kind: Column, other: Column, listing_hit: Column) -> tuple[Column, Column]:
    """Type of an evaluation record, falling back to the other column and to ``generic``, and the mark of a missing image."""
    text = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(text(kind), text(other), F.lit("generic")), F.when(~F.coalesce(listing_hit, F.lit(False)), F.concat(F.lit("[ERROR] not found: "), F.coalesce(image, F.lit(""))))
