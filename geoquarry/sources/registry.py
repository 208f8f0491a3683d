"""The dataset registry: declarative source entries, their resolution and column maps."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default column and tag names of an entry that brings no map of its own.
COLUMNS = {"alpaca": {"prompt": "instruction", "query": "input", "response": "output"}, "sharegpt": {"messages": "conversations"}, "openai": {"messages": "messages"}}
TAGS = {
    "sharegpt": {"role": "from", "content": "value", "user": "human", "assistant": "gpt", "observation": "observation", "function": "function_call", "system": "system"},
    "openai": {"role": "role", "content": "content", "user": "user", "assistant": "assistant", "observation": "tool", "function": "function", "system": "system"},
}
MAPPED = ("prompt", "query", "response", "history", "messages", "system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag")
HUBS = ("hf_hub_url", "ms_hub_url", "om_hub_url")


class RegistryError(ValueError):
    """A name, entry or column that the registry cannot resolve; raised before anything is read."""


@dataclass(frozen=True)
class Source:
    """One registry entry. ``columns`` maps roles of columns to their names, ``tags`` roles of turns to their values."""

    name: str
    kind: str = "file"
    location: str = ""
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)


def parse_entry(name: str, entry: dict) -> Source:
    """A registry entry as ``Source``: hub before script before cloud before file.

    An entry that brings ``columns`` or ``tags`` replaces the defaults as a
    whole: what it leaves out is absent, not defaulted.
    """
    formatting = entry.get("formatting", "alpaca")
    if formatting not in COLUMNS:
        raise RegistryError(f"{name}: unknown formatting {formatting!r}")
    kinds = [("hub", next((entry[h] for h in HUBS if h in entry), None)), ("script", entry.get("script_url")), ("cloud", entry.get("cloud_file_name")), ("file", entry.get("file_name"))]
    kind, location = next(((k, v) for k, v in kinds if v), (None, None))
    if kind is None:
        raise RegistryError(f"{name}: no location")
    given = entry.get("columns")
    columns = {k: v for k, v in given.items() if v} if given is not None else dict(COLUMNS[formatting])
    if unknown := set(columns) - set(MAPPED):
        raise RegistryError(f"{name}: unknown columns {sorted(unknown)}")
    own = entry.get("tags")
    tags = {k.removesuffix("_tag"): v for k, v in own.items()} if own is not None else dict(TAGS.get(formatting, {}))
    plain = {f.name for f in fields(Source)} & {"ranking", "subset", "split", "folder", "num_samples"}
    return Source(name=name, kind=kind, location=location, formatting=formatting, columns=columns, tags=tags, **{k: entry[k] for k in plain if k in entry})


def load_registry(path: str | Path) -> dict[str, Source]:
    """All entries of a registry file, ``dataset_info.json`` of a folder if a folder is given."""
    path = Path(path)
    path = path / "dataset_info.json" if path.is_dir() else path
    try:
        raw = json.loads(path.read_text("utf-8"))
    except OSError as e:
        raise RegistryError(f"no registry at {path}") from e
    return {k: parse_entry(k, v) for k, v in raw.items()}


def resolve(registry: dict[str, Source], names: list[str] | str) -> list[Source]:
    """The entries of ``names``, a list or a comma-separated string, in order; an unknown name raises."""
    wanted = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    if missing := [n for n in wanted if n and n not in registry]:
        raise RegistryError(f"undefined data sets: {', '.join(missing)}")
    return [registry[n] for n in wanted if n]


def check_stage(source: Source, stage: str) -> None:
    """Preference stages take ranking sources, all others take none."""
    if (stage == "rm") != source.ranking:
        raise RegistryError(f"{source.name}: stage {stage} does not fit ranking={source.ranking}")


def catalog(spark: SparkSession, registry: dict[str, Source], stage: str | None = None) -> DataFrame:
    """The registry as a table, for a stage only its sources."""
    rows = [(s.name, s.kind, s.location, s.formatting, s.ranking, s.num_samples) for s in registry.values() if stage is None or s.ranking == (stage == "rm")]
    return spark.createDataFrame(rows, "name string, kind string, location string, formatting string, ranking boolean, num_samples int")


def mapped(df: DataFrame, source: Source) -> DataFrame:
    """Selects the mapped columns under their roles; a mapped column that is missing raises at analysis."""
    if missing := [c for c in source.columns.values() if c not in df.columns]:
        raise RegistryError(f"{source.name}: missing columns {missing}")
    return df.select(*[F.col(f"`{c}`").alias(role) for role, c in source.columns.items()])


def registry_frame(table: DataFrame) -> DataFrame:
    """A registry kept as a table, flattened: name, file_name, formatting and its mapped columns, sorted by role."""
    return table.select("name", "file_name", "formatting", F.col("columns_map.messages").alias("messages"), F.col("columns_map.images").alias("images"))
