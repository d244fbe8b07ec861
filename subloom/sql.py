"""The text functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import presets_table
from .functions.similarity import _ratio
from .sources import srt

# SQL bodies equal to the column forms of ``functions.text``
_SPACE = r"r'(?U)[\\s\\x1c-\\x1f]+'".replace("\\\\", "\\")
FUNCTIONS = {
    "subloom_normalize(s STRING)": ("STRING", f"btrim(regexp_replace(s, {_SPACE}, ' '))"),
    "subloom_merge_key(s STRING)": ("STRING", f"regexp_replace(lower(btrim(regexp_replace(s, {_SPACE}, ' '))), r'[^\\p{{L}}\\p{{N}}]+', '')".replace("\\\\", "\\")),
    "subloom_count(s STRING, letters STRING)": ("INT", "regexp_count(s, concat('[', letters, ']'))"),
    "subloom_srt_time(t DOUBLE)": (
        "STRING",
        "format_string('%02d:%02d:%02d,%03d', div(cast(bround(greatest(t, 0D) * 1000000) as bigint), 3600000000), div(cast(bround(greatest(t, 0D) * 1000000) as bigint), 60000000) % 60, "
        "div(cast(bround(greatest(t, 0D) * 1000000) as bigint), 1000000) % 60, div(cast(bround(greatest(t, 0D) * 1000000) as bigint), 1000) % 1000)",
    ),
}


def register(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> None:
    """Temporary functions, the ``srt`` source, a ``presets`` view and views of the given tables."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("subloom_ratio", _ratio)
    presets_table(spark).createOrReplaceTempView("presets")
    srt.register(spark)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
