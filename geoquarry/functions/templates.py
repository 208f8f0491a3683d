"""Chat templates as slot lists, their rendering, and tool-call dialects."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoquarry.functions.template_table import TEMPLATES as TABLE
from geoquarry.functions.tools import DIALECTS


@dataclass(frozen=True)
class Template:
    """Formats of the roles, each with ``{{content}}`` where the text goes (the tools slot takes the tools' text).

    ``{bos}`` and ``{eos}`` are the tokenizer's tokens, ``{{idx}}`` the number
    of the question. Without a format of its own an answer is its text and
    ``{eos}``, or its text alone where the end is set by the encoder
    (``efficient_eos``); an observation is written like a question, a call
    like an answer.
    """

    name: str
    user: str = "{{content}}"
    assistant: str | None = None
    system: str = "{{content}}"
    observation: str | None = None
    function: str | None = None
    prefix: str = ""
    default_system: str = ""
    tool_format: str = "default"
    stop_words: tuple[str, ...] = ()
    thought_words: tuple[str, str] = ("<think>\n", "\n</think>\n\n")
    reasoning: bool = False
    system_in_user: bool = False
    efficient_eos: bool = False
    replace_eos: bool = False
    enable_thinking: bool | None = True
    media: tuple[str, str | None, str | None, str | None] = ("base", None, None, None)

    def __post_init__(self) -> None:
        if self.assistant is None:
            object.__setattr__(self, "assistant", "{{content}}" if self.efficient_eos else "{{content}}{eos}")
        if self.observation is None:
            object.__setattr__(self, "observation", self.user)
        if self.function is None:
            object.__setattr__(self, "function", self.assistant)


TEMPLATES: dict[str, Template] = {}


def register(template: Template) -> Template:
    if template.name in TEMPLATES:
        raise ValueError(f"template {template.name} exists already")
    for slot in ("user", "assistant", "observation", "function"):
        if "{{content}}" not in getattr(template, slot):
            raise ValueError(f"{template.name}: no placeholder in {slot}")
    TEMPLATES[template.name] = template
    return template


for _name, _slots in TABLE.items():
    register(Template(_name, **_slots))


def resolve(name: str, tool_format: str | None = None, default_system: str | None = None, enable_thinking: bool | None = None) -> Template:
    """A registered template with overrides; an unknown name raises."""
    if name not in TEMPLATES:
        raise ValueError(f"template {name} does not exist")
    given = {k: v for k, v in (("tool_format", tool_format), ("default_system", default_system), ("enable_thinking", enable_thinking)) if v is not None}
    if "tool_format" in given and given["tool_format"] not in DIALECTS:
        raise ValueError(f"tool format {tool_format} does not exist")
    return replace(TEMPLATES[name], **given)


def fill(slot: str, content: Column) -> Column:
    """A slot with its first placeholder filled."""
    before, _, after = slot.partition("{{content}}")
    return F.concat(F.lit(before), content, F.lit(after))


def special_tokens(template: Template, eos: str, pad: str | None = None) -> dict:
    """Effective end, padding and stop tokens."""
    stops = list(template.stop_words)
    return {"eos": stops.pop(0) if template.replace_eos and stops else eos, "pad": pad or eos, "stop": stops}


def render(template: Template, messages: Column, system: Column | None = None, tools: Column | None = None, bos: str = "<s>", eos: str = "</s>") -> Column:
    """The texts of a dialogue's turns, an array; the first carries prefix, system and tools.

    Reasoning templates drop thoughts of all answers but the last. Without
    thinking (``enable_thinking`` False) they put an empty thought before an
    answer that has none.
    """
    own = lambda slot: slot.replace("{bos}", bos).replace("{eos}", eos)
    t = replace(template, **{k: own(getattr(template, k)) for k in ("user", "assistant", "system", "observation", "function", "prefix")})
    n = F.size(messages)
    given = F.lit(t.default_system) if system is None else F.when(F.length(system) > 0, system).otherwise(F.lit(t.default_system))
    head_text = given if tools is None else F.concat(given, F.coalesce(tools, F.lit("")))
    head = F.when(F.length(head_text) > 0, fill(t.system, head_text)).otherwise(F.lit(""))

    def turn(m: Column, i: Column) -> Column:
        text = m["content"]
        if t.reasoning:
            last = with_empty_thought(text, t.thought_words) if t.enable_thinking is False else text
            text = F.when((m["role"] == "assistant") & (i < n - 1), without_thought(text, t.thought_words)).when(m["role"] == "assistant", last).otherwise(text)
        if t.system_in_user:
            text = F.when(i == 0, F.concat(head, text)).otherwise(text)
        asked = fill(t.user, text)
        if "{{idx}}" in t.user:
            before, _, after = t.user.partition("{{idx}}")
            asked = F.concat(F.lit(before), F.floor(i / 2).cast("string"), fill(after, text))
        body = F.when(m["role"] == "user", asked).when(m["role"] == "assistant", fill(t.assistant, text)).when(m["role"] == "observation", fill(t.observation, text)).otherwise(fill(t.function, text))
        lead = F.lit(t.prefix) if t.system_in_user else F.concat(F.lit(t.prefix), head)
        return F.when(i == 0, F.concat(lead, body)).otherwise(body)

    return F.transform(messages, turn)


def without_thought(text: Column, words: tuple[str, str] = ("<think>\n", "\n</think>\n\n")) -> Column:
    """Removes thought blocks, shortest match first, and line breaks at the beginning."""
    a, b = (re.escape(w.strip()).replace("\\<", "<").replace("\\>", ">") for w in words)
    return F.regexp_replace(F.regexp_replace(text, f"(?s){a}.*?{b}", ""), r"^\n+", "")


def with_empty_thought(text: Column, words: tuple[str, str] = ("<think>\n", "\n</think>\n\n")) -> Column:
    """Puts an empty thought before a text that has none."""
    return F.when(text.contains(words[0].strip()) | text.contains(words[1].strip()), text).otherwise(F.concat(F.lit("".join(words)), text))


def jinja(template: Template) -> str:
    """The template as text in a common templating language."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    slot = lambda s: " + ".join(x for x in (q(s.partition("{{content}}")[0]), "message['content']", q(s.partition("{{content}}")[2])) if x != "''")
    lines = [f"{{{{ {q(template.prefix)} }}}}" if template.prefix else "", "{% for message in messages %}"]
    for i, role in enumerate(("system", "user", "assistant", "tool")):
        lines.append(f"{{% {'if' if not i else 'elif'} message['role'] == '{role}' %}}{{{{ {slot(getattr(template, 'observation' if role == 'tool' else role))} }}}}")
    return "".join([*lines, "{% endif %}{% endfor %}"])


def inferred(render_probe: Callable[[list[dict]], str], name: str) -> Template:
    """A template from a function that renders messages: slots are what stands around marked texts."""
    one = render_probe([{"role": "user", "content": "\x01"}])
    both = render_probe([{"role": "user", "content": "\x01"}, {"role": "assistant", "content": "\x02"}])
    lead = render_probe([{"role": "system", "content": "\x03"}, {"role": "user", "content": "\x01"}])
    before_user, after_user = one.split("\x01", 1)
    middle, after_assistant = both.split("\x01", 1)[1].split("\x02", 1)
    system = lead.split("\x03", 1)
    return Template(name, user=before_user + "{{content}}" + middle, assistant="{{content}}" + after_assistant, system=system[0] + "{{content}}" + system[1].split(before_user + "\x01", 1)[0] if before_user else system[0] + "{{content}}")
