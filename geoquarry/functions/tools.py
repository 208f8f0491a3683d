"""Tool-call dialects: how tools are offered in a prompt, how calls are written and how they are read back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompts by which models are offered tools. {tools} takes the tools' text, {names} their names, {date} a date.
DEFAULT_OFFER = """You have access to the following tools:
{tools}Use the following format if using a tool:
```
Action: tool name (one of [{names}])
Action Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```)
```
"""
GLM4_OFFER = "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具{tools}"
GLM4_TOOL = "\n\n## {name}\n\n{body}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
GLM4_MOE_OFFER = """

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>{tools}
</tools>

For each function call, output the function name and arguments within the following XML format:
<tool_call>{function-name}
<arg_key>{arg-key-1}</arg_key>
<arg_value>{arg-value-1}</arg_value>
<arg_key>{arg-key-2}</arg_key>
<arg_value>{arg-value-2}</arg_value>
...
</tool_call>
"""
LLAMA3_OFFER = """Cutting Knowledge Date: December 2023
Today Date: {date}

You have access to the following functions. To call a function, please respond with JSON for a function call. Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.

{tools}"""
QWEN_OFFER = """

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>{tools}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call>"""
SEED_OFFER = """system
You are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query.Tool List:
You are authorized to use the following tools (described in JSON Schema format). Before performing any task, you must decide how to call them based on the descriptions and parameters of these tools.{tools}
工具调用请遵循如下格式:
<seed:tool_call>
<function=example_function_name>
<parameter=example_parameter_1>value_1</parameter>
<parameter=example_parameter_2>This is the value for the second parameter
that can span
multiple lines</parameter>
</function>
</seed:tool_call>
"""
MISTRAL_OFFER = "[AVAILABLE_TOOLS] {tools}[/AVAILABLE_TOOLS]"
LING_OFFER = QWEN_OFFER.lstrip("\n") + "\ndetailed thinking off"


@dataclass(frozen=True)
class Dialect:
    name: str
    offer: Callable[[list[dict]], str]
    write: Callable[[list[tuple[str, str]]], str]
    read: Callable[[str], str | list[tuple[str, str]]]


DIALECTS: dict[str, Dialect] = {}


def register_dialect(d: Dialect) -> None:
    if d.name in DIALECTS:
        raise ValueError(f"tool dialect {d.name} exists already")
    DIALECTS[d.name] = d


def dialect(name: str) -> Dialect:
    try:
        return DIALECTS[name]
    except KeyError:
        raise ValueError(f"tool format {name} does not exist") from None


def dumps(x: object, indent: int | None = None) -> str:
    return json.dumps(x, ensure_ascii=False, indent=indent)


def bare(tool: dict) -> dict:
    """The function's own description, without its wrapper."""
    return tool.get("function", {}) if tool.get("type") == "function" else tool


def wrapped(tool: dict) -> dict:
    return tool if tool.get("type") == "function" else {"type": "function", "function": tool}


def _fill(offer: str, **slots: str) -> str:
    for name, text in slots.items():
        offer = offer.replace("{" + name + "}", text, 1)
    return offer


def _argument(name: str, spec: dict, required: bool) -> str:
    """One line on an argument of a tool in the default dialect."""
    notes = spec.get("description", "")
    if spec.get("enum"):
        notes += f", should be one of [{', '.join(spec['enum'])}]"
    if spec.get("items"):
        notes += f", where each item should be {spec['items'].get('type', '')}"
    return f"  - {name} ({spec.get('type', '')}{', required' if required else ''}): {notes}\n"


def _described(tool: dict) -> str:
    params = tool["parameters"]
    rows = [_argument(name, spec, name in params.get("required", ())) for name, spec in params["properties"].items()]
    return f"> Tool Name: {tool['name']}\nTool Description: {tool.get('description', '')}\nTool Args:\n{''.join(rows)}\n"


def _offer_default(tools: list[dict]) -> str:
    own = [bare(t) for t in tools]
    # Names first: a tool's text may hold anything, braces included.
    return _fill(_fill(DEFAULT_OFFER, names=", ".join(t["name"] for t in own)), tools="".join(map(_described, own)))


def _offer_lines(offer: str) -> Callable[[list[dict]], str]:
    return lambda tools: _fill(offer, tools="".join("\n" + dumps(wrapped(t)) for t in tools))


def parsed(text: str) -> object | None:
    try:
        return json.loads(text)
    except ValueError:
        return None


def _calls(items: list, arguments: str = "arguments") -> list[tuple[str, str]] | None:
    out = []
    for x in items:
        if not isinstance(x, dict) or "name" not in x or arguments not in x:
            return None
        out.append((x["name"], dumps(x[arguments])))
    return out


def scan_actions(text: str) -> Iterator[tuple[str, str]]:
    """(name, input) of each "Action: name / Action Input: text" block; the input reaches to the next action or the end."""
    action, given = "Action:", "Action Input:"
    at = text.find(action)
    while at >= 0:
        body = text[at + len(action) :].lstrip()
        end = 0
        while end < len(body) and (body[end].isascii() and body[end].isalnum() or body[end] == "_"):
            end += 1
        rest = body[end:].lstrip()
        start = len(text) - len(rest)
        if not end or not rest.startswith(given):
            at = text.find(action, at + 1)
            continue
        following = text.find(action, start + len(given))
        raw = text[start + len(given) : following if following >= 0 else len(text)].strip()
        if raw:
            yield body[:end], raw
        at = following


def _read_actions(text: str) -> str | list[tuple[str, str]]:
    out = []
    for name, raw in scan_actions(text):
        for mark in '"`':
            raw = raw.strip(mark)
        value = parsed(raw)
        if value is None and raw != "null":
            return text
        out.append((name, dumps(value)))
    return out or text


def _read_lines(text: str) -> str | list[tuple[str, str]]:
    name, line, raw = text.partition("\n")
    value = parsed(raw.strip()) if line else None
    return text if value is None else [(name, dumps(value))]


def _read_list(arguments: str) -> Callable[[str], str | list[tuple[str, str]]]:
    def read(text: str) -> str | list[tuple[str, str]]:
        value = parsed(text.strip())
        calls = None if value is None else _calls(value if isinstance(value, list) else [value], arguments)
        return calls or text

    return read


def _read_tags(text: str) -> str | list[tuple[str, str]]:
    found = [parsed(x.strip()) for x in re.findall(r"<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", text, re.S)]
    calls = _calls(found) if found and None not in found else None
    return calls or text


def _read_parameters(text: str) -> list[tuple[str, str]]:
    out = []
    for call in text.split("<seed:tool_call>")[1:]:
        body = call.partition("</seed:tool_call>")[0].strip().removeprefix("<function=").lstrip()
        end = next((i for i, c in enumerate(body) if c.isspace() or c == "<"), len(body))
        name, values = body[:end], {}
        for part in body.split("<parameter=")[1:]:
            key, _, raw = part.partition(">")
            raw = raw.partition("</parameter>")[0]
            value = parsed(raw.strip())
            values[key] = raw if value is None else value
        if name.strip():
            out.append((name.strip(), dumps(values)))
    return out


def _text(value: object) -> str:
    return value if isinstance(value, str) else dumps(value)


def _write_glm4(calls: list[tuple[str, str]]) -> str:
    if len(calls) > 1:
        raise ValueError("one call only")
    return "\n".join(calls[0])


def _write_named(key: str, single: bool) -> Callable[[list[tuple[str, str]]], str]:
    def write(calls: list[tuple[str, str]]) -> str:
        items = [{"name": n, key: json.loads(a)} for n, a in calls]
        return dumps(items[0] if single and len(items) == 1 else items)

    return write


def _write_tags(calls: list[tuple[str, str]]) -> str:
    return "\n".join("<tool_call>\n" + dumps({"name": n, "arguments": json.loads(a)}) + "\n</tool_call>" for n, a in calls)


def _write_pairs(calls: list[tuple[str, str]]) -> str:
    pair = lambda k, v: f"\n<arg_key>{k}</arg_key>\n<arg_value>{_text(v)}</arg_value>"
    return "\n".join(f"\n<tool_call>{n}" + "".join(pair(k, v) for k, v in json.loads(a).items()) for n, a in calls)


def _write_parameters(calls: list[tuple[str, str]]) -> str:
    one = lambda k, v: f"\n<parameter={k}>{_text(v)}</parameter>"
    return "\n".join(f"\n<seed:tool_call>\n<function={n}" + "".join(one(k, v) for k, v in json.loads(a).items()) + "\n</function>\n</seed:tool_call>" for n, a in calls)


register_dialect(Dialect("default", _offer_default, lambda calls: "\n".join(f"Action: {n}\nAction Input: {a}" for n, a in calls), _read_actions))
register_dialect(Dialect("glm4", lambda tools: _fill(GLM4_OFFER, tools="".join(_fill(GLM4_TOOL, name=t["name"], body=dumps(t, 4)) for t in map(bare, tools))), _write_glm4, _read_lines))
register_dialect(Dialect("llama3", lambda tools: _fill(LLAMA3_OFFER, tools="".join(dumps(wrapped(t), 4) + "\n\n" for t in tools)), _write_named("parameters", True), _read_list("parameters")))
register_dialect(Dialect("mistral", lambda tools: _fill(MISTRAL_OFFER, tools=dumps([wrapped(t) for t in tools])), _write_named("arguments", False), _read_list("arguments")))
register_dialect(Dialect("qwen", _offer_lines(QWEN_OFFER), _write_tags, _read_tags))
register_dialect(Dialect("glm4_moe", _offer_lines(GLM4_MOE_OFFER), _write_pairs, _read_tags))
register_dialect(Dialect("seed_oss", lambda tools: _fill(SEED_OFFER, tools="\n" + dumps(tools)), _write_parameters, _read_parameters))
register_dialect(Dialect("ling", _offer_lines(LING_OFFER), _write_tags, _read_tags))


def offered(name: str, tools: str, date: str = "") -> str:
    """The prompt text that offers tools, given as JSON; an empty list offers nothing. Dates are a parameter, not the clock."""
    listed = json.loads(tools)
    return dialect(name).offer(listed).replace("{date}", date, 1) if listed else ""


def offer_column(name: str, tools: Column, date: str = "") -> Column:
    """``offered`` over a column of tool lists as JSON; null for null and for what is no list of tools."""
    dialect(name)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        for text in column.dropna().unique():
            try:
                known[text] = offered(name, text, date)
            except (ValueError, KeyError, AttributeError, TypeError):
                known[text] = None
        return column.map(known, na_action="ignore").astype(object)

    return run(tools)


def written(name: str, content: str, words: tuple[str, str] = ("<think>", "</think>")) -> str:
    """A function message, one call or a list as JSON, in a dialect; a thought before it stays before it."""
    thought = re.match(re.escape(words[0]) + r".*?" + re.escape(words[1]) + r"\s*", content, re.S)
    lead = thought.group() if thought else ""
    value = json.loads(content[len(lead) :])
    return lead + dialect(name).write([(c["name"], dumps(c["arguments"])) for c in (value if isinstance(value, list) else [value])])


def _by_value(column: pd.Series, f: Callable[[str], str | None]) -> pd.Series:
    known = {}
    for text in column.dropna().unique():
        try:
            known[text] = f(text)
        except (ValueError, KeyError, AttributeError, TypeError):
            known[text] = None
    return column.map(known, na_action="ignore").astype(object)


def write_column(name: str, calls: Column) -> Column:
    """``written`` over a column of function messages; null for what is none."""
    dialect(name)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return _by_value(column, lambda text: written(name, text))

    return run(calls)


def read_column(name: str, text: Column) -> Column:
    """The calls a reply holds as a JSON list of name and arguments; null where it is plain text."""
    dialect(name)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            calls = dialect(name).read(text)
            return None if isinstance(calls, str) else dumps([{"name": n, "arguments": json.loads(a)} for n, a in calls])

        return _by_value(column, one)

    return run(text)


def extracted_actions(text: Column) -> Column:
    """Calls of the default dialect as (name, arguments), in the JVM; null where any argument is no JSON or there is no call."""
    pattern = r"Action:\s*(\w+)\s*Action Input:\s*((?s).+?)(?=\s*Action:|\s*$)"
    names, raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    calls = F.arrays_zip(names.alias("name"), raw.alias("arguments"))
    good = F.forall(raw, lambda a: F.try_parse_json(a).isNotNull())
    return F.when((F.size(names) > 0) & good, calls)


def extracted_tags(text: Column) -> Column:
    """Calls of the tagged dialect as (name, arguments), in the JVM; null where one is no JSON or lacks a part."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.+?)</tool_call>"), F.lit(1))
    calls = F.transform(raw, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    good = F.forall(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    return F.when((F.size(raw) > 0) & good, calls)
