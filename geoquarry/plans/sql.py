"""The tables and the engine's functions for ``spark.sql``."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import textscore
from geoquarry.functions.tools import DIALECTS, dumps, offered

# Functions that are expressions: Catalyst sees through them.
EXPRESSIONS = {
    "normal_form": ("text STRING", "STRING", r"trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' '))"),
    "image_name": ("path STRING", "STRING", r"nullif(lower(regexp_replace(regexp_replace(trim(path), '^.*[/\\\\]', ''), '\\.[^.]*$', '')), '')"),
    "scene_of": ("name STRING", "STRING", "substring_index(name, '_', 1)"),
    "box_area": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "(x2 - x1) * (y2 - y1)"),
    "box_iou": (
        "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE",
        "DOUBLE",
        "(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0)) / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) + 1e-7)",
    ),
}


def register(spark: SparkSession, folder: str | None = None) -> list[str]:
    """Registers the functions, and every table of ``folder`` as a temporary view; gives the names of the views."""
    for name, (params, returns, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")

    @F.pandas_udf("string")
    def tool_offer(dialect: pd.Series, tools: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or t is None or d not in DIALECTS else offered(d, t) for d, t in zip(dialect, tools)], dtype=object)

    @F.pandas_udf("string")
    def tool_calls(dialect: pd.Series, text: pd.Series) -> pd.Series:
        def one(d: str | None, t: str | None) -> str | None:
            found = DIALECTS[d].read(t) if d in DIALECTS and t is not None else None
            return dumps([{"name": n, "arguments": a} for n, a in found]) if isinstance(found, list) else None

        return pd.Series([one(d, t) for d, t in zip(dialect, text)], dtype=object)

    spark.udf.register("tool_offer", tool_offer)
    spark.udf.register("tool_calls", tool_calls)
    spark.udf.register("rouge_l", textscore.rouge_l)
    if folder is None:
        return []
    names = sorted(p.stem for p in Path(folder).glob("*.parquet")) if "://" not in folder else []
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return names
