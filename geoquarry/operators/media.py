"""Expanding the media marks of a text into the tokens that a model's plugin wants.

A rule turns one medium, a struct, into text. Grids are in patches (t, h, w),
plain images have height and width in pixels, counts that only a processor
knows come with the medium. Marks and tokens are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = {"image": "<image>", "video": "<video>", "audio": "<audio>"}
Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class Sizes:
    """What a processor is set to."""

    merge: int = 2
    patch: int = 14
    extra: int = 1
    default_strategy: bool = True
    tokens: int = 256


def _many(token: str, n: Column) -> Column:
    return F.repeat(F.lit(token), F.greatest(n.cast("int"), F.lit(0)))


def _around(begin: str, body: Column, end: str) -> Column:
    return F.concat(F.lit(begin), body, F.lit(end))


def grid_tokens(m: Column, merge: int) -> Column:
    """Tokens of a grid after merging."""
    return F.floor(m["t"] * m["h"] * m["w"] / merge**2)


def frame_tokens(m: Column, merge: int) -> Column:
    return F.floor(m["h"] * m["w"] / merge**2)


def feature_tokens(m: Column, s: Sizes, image: bool = True) -> Column:
    """Tokens of an image cut into patches, with what the model adds; images lose one where it drops the class token."""
    n = F.floor(m["height"] / s.patch) * F.floor(m["width"] / s.patch) + s.extra
    return n - 1 if image and s.default_strategy else n


def _segments(begin: str, token: str, end: str, merge: int) -> Rule:
    """A grid in one segment, or its global and its semantic part in two where their counts add up to the grid's."""

    def rule(m: Column) -> Column:
        n = grid_tokens(m, merge)
        split = (m["global_n"] + m["semantic_n"]) == n
        two = F.concat(_around(begin, _many(token, m["global_n"]), end), _around(begin, _many(token, m["semantic_n"]), end))
        return F.when(F.coalesce(split, F.lit(False)), two).otherwise(_around(begin, _many(token, n), end))

    return rule


def _whole(begin: str, token: str, end: str, merge: int) -> Rule:
    return lambda m: _around(begin, _many(token, grid_tokens(m, merge)), end)


def _timed_frames(frame: Callable[[Column, Column], Column]) -> Rule:
    """Each frame of a video with its time; a video with fewer times than frames repeats the last one."""
    at = lambda m, i: F.coalesce(F.try_element_at(m["times"], F.least(i + 1, F.size(m["times"])).cast("int")), F.lit(0.0))
    return lambda m: F.array_join(F.transform(F.sequence(F.lit(0), m["t"] - 1), lambda i: frame(m, at(m, i))), "")


def _rows_with_breaks(token: str, row_end: str, end: str, s: Sizes) -> Rule:
    def rule(m: Column) -> Column:
        side = s.patch * s.merge
        row = F.concat(_many(token, F.floor(m["width"] / side)), F.lit(row_end))
        rows = F.repeat(row, F.floor(m["height"] / side).cast("int"))
        return F.concat(F.substring(rows, 1, F.length(rows) - len(row_end)), F.lit(end))

    return rule


def _tiles(s: Sizes) -> Rule:
    """Tiles of an image row by row with separators between them, then the whole image once."""

    def rule(m: Column) -> Column:
        one = _many("<|patch|>", F.floor(m["height"] / s.patch) * F.floor(m["width"] / s.patch))
        row = F.concat(one, F.repeat(F.concat(F.lit("<|tile_x_separator|>"), one), (m["w"] - 1).cast("int")), F.lit("<|tile_y_separator|>"))
        tiles = F.when(m["h"] * m["w"] > 1, F.repeat(row, m["h"].cast("int"))).otherwise("")
        return F.concat(F.lit("<|image_start|>"), tiles, F.lit("<|image|>"), one, F.lit("<|image_end|>"))

    return rule


def rules(plugin: str, image: str | None = None, video: str | None = None, audio: str | None = None, sizes: Sizes | None = None, vision: tuple[str, str] = ("<|vision_start|>", "<|vision_end|>"), sound: tuple[str, str] = ("<|audio_bos|>", "<|audio_eos|>")) -> dict[str, Rule]:
    """What a plugin makes of an image, a video and an audio; kinds that it does not take are left out."""
    s = sizes or Sizes()
    i, v, a = image or "<image>", video or "<video>", audio or "<audio>"
    begin, end = vision
    per_frame = lambda m, t: F.concat(F.format_string("<%.1f seconds>", t), _around(begin, _many(v, frame_tokens(m, s.merge)), end))
    dated = lambda m, t: F.concat(_around("<|begin_of_image|>", _many(i, frame_tokens(m, s.merge)), "<|end_of_image|>"), t.cast("int").cast("string"))
    framed = lambda m: F.array_join(F.transform(m["patches"], lambda n, k: F.concat(F.lit("Frame"), (k + 1).cast("string"), F.lit(": "), _around("<img>", _many("<IMG_CONTEXT>", n * s.tokens), "</img>"))), "\n")
    soft = lambda begin_, token, end_: lambda m: _around(begin_, _many(token, F.lit(s.tokens)), end_)
    heard = lambda m: F.floor((F.floor((m["frames"] - 1) / 2) + 1 - 2) / 2) + 1
    table: dict[str, dict[str, Rule]] = {
        "base": {},
        "gemma3": {"image": soft("\n\n<start_of_image>", i, "<end_of_image>\n\n")},
        "gemma3n": {"image": soft("\n\n<start_of_image>", i, "<end_of_image>\n\n"), "audio": soft("\n\n<start_of_audio>", a, "<end_of_audio>\n\n")},
        "glm4v": {"image": _whole("<|begin_of_image|>", i, "<|end_of_image|>", s.merge), "video": lambda m: _around("<|begin_of_video|>", _timed_frames(dated)(m), "<|end_of_video|>")},
        "intern_vl": {"image": lambda m: _around("<img>", _many("<IMG_CONTEXT>", m["tiles"] * s.tokens), "</img>"), "video": framed},
        "kimi_vl": {"image": _whole("<|media_start|>image<|media_content|>", i, "<|media_end|>", s.merge)},
        "llama4": {"image": _tiles(s)},
        "llava": {"image": lambda m: _many(i, feature_tokens(m, s))},
        "llava_next": {"image": lambda m: _many(i, m["features"] - int(s.default_strategy))},
        "llava_next_video": {"image": lambda m: _many(i, m["features"] - int(s.default_strategy)), "video": lambda m: _many(v, F.floor(F.floor(m["height"] / s.patch) * F.floor(m["width"] / s.patch) / 4) * m["t"])},
        "minicpm_v": {"image": lambda m: F.lit("(<image>./</image>)"), "video": lambda m: F.repeat(F.lit("(<image>./</image>)"), m["t"].cast("int")), "audio": lambda m: F.lit("(<audio>./</audio>)")},
        "mllama": {"image": lambda m: F.lit(i)},
        "paligemma": {"image": lambda m: F.lit("")},
        "pixtral": {"image": _rows_with_breaks(i, "[IMG_BREAK]", "[IMG_END]", s)},
        "qwen2_audio": {"audio": lambda m: _around(sound[0], _many(a, heard(m)), sound[1])},
        "qwen2_vl": {"image": _segments(begin, i, end, s.merge), "video": _whole(begin, v, end, s.merge)},
        "qwen3_vl": {"image": _segments(begin, i, end, s.merge), "video": _timed_frames(per_frame)},
        "qwen2_omni": {"image": _whole(begin, i, end, s.merge), "video": _whole(begin, v, end, s.merge), "audio": lambda m: _around(sound[0], _many(a, heard(m)), sound[1])},
        "video_llava": {"image": lambda m: _many(i, feature_tokens(m, s)), "video": lambda m: _many(v, feature_tokens(m, s, False) * m["t"])},
    }
    if plugin not in table:
        raise ValueError(f"media plugin {plugin} does not exist")
    return table[plugin]


PLUGINS = ("base", "gemma3", "gemma3n", "glm4v", "intern_vl", "kimi_vl", "llama4", "llava", "llava_next", "llava_next_video", "minicpm_v", "mllama", "paligemma", "pixtral", "qwen2_audio", "qwen2_vl", "qwen3_vl", "qwen2_omni", "video_llava")


def expand(text: Column, kind: str, media: Column, rule: Rule) -> Column:
    """``text`` with its k-th mark of a kind replaced by what the rule makes of the k-th medium; marks without a medium stay."""
    mark = MARKS[kind]
    parts, made = F.split(text, mark, -1), F.transform(media, rule)
    piece = lambda k: F.coalesce(F.try_element_at(made, k), F.lit(mark))
    return F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(piece(k.cast("int")), p))), "")


def prefixed_ids(ids: Column, labels: Column, token: int, images: Column, tokens: int, ignore: int = -100) -> tuple[Column, Column]:
    """Ids with the tokens of all images before them, and labels that ignore these: for plugins whose marks vanish from the text."""
    n = (F.coalesce(F.size(images), F.lit(0)) * tokens).cast("int")
    return F.concat(F.array_repeat(F.lit(token), n), ids), F.concat(F.array_repeat(F.lit(ignore), n), labels)
