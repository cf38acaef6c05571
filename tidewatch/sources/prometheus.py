"""Prometheus text exposition, landed as one scrape body per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.functions.parsing import BLANKS, last_wins

# Label pairs and line ends.
LABEL_PAIR = r'(?U)(\w+)="([^"]*)"'
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
DEFAULT_TYPE = "gauge"


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)


def prometheus_samples(
    bodies: DataFrame,
    scraped_at: Column,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Samples of scrapes. ``bodies``: body_id (unique), source, body; ``scraped_at`` may be a column of it.

    The type of a sample is that of the last TYPE line before it for its name without the last ``_part``, else for
    its full name, else gauge. TYPE lines become ranges of positions, so each sample finds at most one.
    """
    line = F.btrim("line", F.lit(BLANKS))
    bodies = bodies.withColumn("__at", scraped_at)
    lines = bodies.select("body_id", "source", "__at", F.posexplode(F.split("body", LINE_END)).alias("pos", "line"))
    lines = lines.withColumn("line", line).filter(F.col("line") != "")

    words = F.split("line", r"(?U)\s+")
    types = lines.filter(F.col("line").startswith("# TYPE ") & (F.size(words) >= 4))
    types = types.select("body_id", "pos", F.get(words, 2).alias("name"), F.get(words, 3).alias("kind"))
    later = Window.partitionBy("body_id", "name").orderBy("pos")
    types = types.withColumn("until", F.coalesce(F.lead("pos").over(later), F.lit(2**31 - 1)))

    brace, close = F.instr("line", "{"), F.instr("line", "}")
    braced = brace > 0
    name = F.when(braced, F.substring("line", F.lit(1), brace - 1)).otherwise(_first_word(F.col("line")))
    inner = F.when(braced & (close > brace), F.substring("line", brace + 1, close - brace - 1)).otherwise("")
    rest = F.when(braced, F.substring("line", close + 1, F.length("line"))).otherwise(
        F.regexp_replace("line", r"(?U)^\S+", "")
    )
    sampled = ~F.col("line").startswith("#") & ((brace == 0) | (close > 0))

    def sample(value: Column, named: Column) -> Column:
        kept = value.isNotNull() & S.name_selected(named, include or [], exclude or [])
        pair = [F.regexp_extract_all(inner, F.lit(LABEL_PAIR), F.lit(i)) for i in (1, 2)]
        return F.when(kept, F.struct(named.alias("name"), last_wins(*pair).alias("labels"), value.alias("value")))

    number = S.let(_first_word(rest), S.to_number)
    parsed = F.when(sampled, S.let(number, lambda v: S.let(name, lambda n: sample(v, n))))
    kept = F.inline(F.array_compact(F.array(parsed)))  # drops lines without a sample, parses each line once
    samples = lines.select("body_id", "source", "__at", "pos", kept)
    samples = samples.withColumn("base", F.regexp_replace("name", "_[^_]*$", ""))

    def typed(df: DataFrame, key: str, out: str) -> DataFrame:
        ranges = types.select(
            F.col("body_id").alias("__body"),
            F.col("name").alias("__name"),
            F.col("pos").alias("__from"),
            F.col("until").alias("__until"),
            F.col("kind").alias(out),
        )
        inside = (F.col("body_id") == F.col("__body")) & (F.col(key) == F.col("__name"))
        inside = inside & (F.col("pos") > F.col("__from")) & (F.col("pos") < F.col("__until"))
        return df.join(ranges, inside, "left").drop("__body", "__name", "__from", "__until")

    samples = typed(typed(samples, "base", "__base_kind"), "name", "__kind")
    return samples.select(
        "body_id",
        "name",
        S.labels_hash(F.col("labels")).alias("labels_hash"),
        S.labels_json(F.col("labels")).alias("labels"),
        "value",
        F.col("__at").alias("timestamp"),
        F.coalesce("__base_kind", "__kind", F.lit(DEFAULT_TYPE)).alias("metric_type"),
        "source",
    )
