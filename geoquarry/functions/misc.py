"""Small column functions: media URIs, names, cache keys, sizes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that a source's name loses.
SPECIAL = r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]"


def media_uri(uri: Column) -> tuple[Column, Column]:
    """Media type and bytes of a data URI in base 64; null for anything else, also for what is no base 64."""
    pattern = r"^data:((?:image|video|audio)/[\w.+-]+);base64,(.*)$"
    kind = F.nullif(F.regexp_extract(uri, pattern, 1), F.lit(""))
    return kind, F.when(kind.isNotNull(), F.try_to_binary(F.regexp_extract(uri, pattern, 2), F.lit("base64")))


def clean_name(name: Column) -> Column:
    """Special characters as underscores."""
    return F.regexp_replace(name, SPECIAL, "_")


def content_key(data: Column, downsample: bool, patch: int, divisor: int = 8, digits: int = 32) -> Column:
    """Cache key of an image: digits of the MD5 of its raw bytes, and the parameters. All 32 by default; 8 is the short form, which collides sooner."""
    return F.concat(F.substring(F.md5(data), 1, digits), F.lit(f"_g{int(downsample)}_gd{divisor}_s{patch}"))


def media_key(images: Column, videos: Column, audios: Column, downsample: bool, patch: int, version: str = "media_inputs_v1") -> Column:
    """Key of a row's media from ``images``, an array of (width, height, data): sizes, 16 digits of each MD5, counts of the rest; null without images."""
    signed = F.transform(images, lambda i: F.concat(i["width"].cast("string"), F.lit("x"), i["height"].cast("string"), F.lit(":"), F.substring(F.md5(i["data"]), 1, 16)))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    key = F.concat_ws("|", F.lit(version), F.lit(str(int(downsample))), F.lit(str(patch)), F.array_join(signed, ","), count(videos), count(audios))
    return F.when(F.size(images) > 0, key)


def human_count(n: Column) -> Column:
    """A count of parameters for people: 7.0B, 136M, 1.5K, 999."""
    return (
        F.when(n >= 1e9, F.format_string("%.1fB", n / 1e9))
        .when(n >= 1e6, F.format_string("%.0fM", n / 1e6))
        .when(n >= 1e3, F.format_string("%.1fK", n / 1e3))
        .otherwise(n.cast("string"))
    )


def upright_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height of an image after its EXIF rotation; 6 and 8 swap them."""
    turned = F.coalesce(orientation.isin(6, 8), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def prompt_date(ts: Column) -> Column:
    """A date as tool prompts write it: 01 Jan 2025."""
    return F.date_format(ts, "dd MMM yyyy")


def elapsed(seconds: Column) -> Column:
    """Seconds as h:mm:ss, with days before them where there are any."""
    whole = F.floor(seconds).cast("bigint")
    days, rest = F.floor(whole / 86400), whole % 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(F.when(days == 0, "").when(days == 1, F.lit("1 day, ")).otherwise(F.format_string("%d days, ", days)), clock)


def log_tail(log: Column, most: int = 20000) -> Column:
    """The last characters of a log."""
    return F.right(log, F.lit(most))
