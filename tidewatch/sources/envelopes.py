"""Payloads of log and metric collectors, landed as one JSON body per row, flattened to rows.

``bodies`` has a column ``body`` (text) and any key columns, which are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import scalars as S

DEFAULT_HTTP_SOURCE = "http"
DEFAULT_OTEL_SOURCE = "otel"


def _keys(df: DataFrame, *used: str) -> list[str]:
    return [c for c in df.columns if c not in used]


def http_log_lines(bodies: DataFrame) -> DataFrame:
    """JSON log posts: an object or an array of objects, of which only ``message`` counts.

    Entries that are no objects or have no message are dropped; line_number counts the accepted ones from 0.
    Source is the ``x_source`` column, else "http". In a body with a repeated key, the last one counts, and every
    message that is not empty text is taken as it stands.
    """
    keys = _keys(bodies, "body", "x_source")
    body = F.btrim("body", F.lit(" \t\n\r"))
    # An entry that is no object becomes a null struct; an entry without message has a null message.
    wrapped = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    entries = F.from_json(wrapped, "array<variant>")
    messages = F.transform(
        entries,
        lambda e: F.struct(
            F.try_variant_get(e, "$.message", "string").alias("text"),
            F.schema_of_variant(F.try_variant_get(e, "$.message", "variant")).alias("type"),
        ),
    )

    def filled(m: Column) -> Column:
        """Empty text, zero, false, an empty list or object count as no message."""
        number = ~m["type"].isin("STRING", "BOOLEAN") & (m["text"].try_cast("double") == 0)
        empty = (m["text"] == "") | ((m["type"] != "STRING") & m["text"].isin("false", "[]", "{}"))
        return m["text"].isNotNull() & ~empty & ~F.coalesce(number, F.lit(False))

    def last_message(entry: Column) -> Column:
        parsed = F.from_json(entry, "map<string,string>", {"allowSingleQuotes": "false"})
        found = F.filter(F.map_entries(parsed), lambda e: e["key"] == "message")
        return F.try_element_at(found, F.lit(-1))["value"]

    # a variant takes no object with a repeated key, wherever in the body that is
    texts = F.transform(F.from_json(wrapped, "array<string>"), last_message)
    plain = F.filter(texts, lambda m: m.isNotNull() & (m != ""))
    accepted = F.transform(F.filter(messages, filled), lambda m: m["text"])
    accepted = F.when(entries.isNotNull(), accepted).otherwise(plain)
    source = F.coalesce("x_source", F.lit(DEFAULT_HTTP_SOURCE)) if "x_source" in bodies.columns else F.lit("http")
    flat = bodies.select(*keys, source.alias("source"), F.posexplode(accepted).alias("line_number", "line"))
    return flat.withColumn("line_number", F.col("line_number").cast("bigint"))


def source_of_labels(labels: Column, matchers: list[tuple[str, dict[str, str]]]) -> Column:
    """The first configured source all of whose required labels are among ``labels``; null if none."""

    def contains(required: dict[str, str]) -> Column:
        out = F.lit(True)
        for name, value in required.items():
            out = out & F.coalesce(F.try_element_at(labels, F.lit(name)) == value, F.lit(False))
        return out

    return F.coalesce(F.lit(None).cast("string"), *[F.when(contains(r), F.lit(s)) for s, r in matchers])


def match_sources(label_sets: DataFrame, matchers: DataFrame) -> DataFrame:
    """The same with the matchers in a table (ord, source, required), for any number of them.

    A label set matches a source when as many of its pairs are required by the source as the source has pairs: an
    equi-join of the distinct label sets on single pairs, no comparison of every set with every source. A source that
    requires nothing matches every label set. Returns (label_key, source), where label_key is the JSON text of the
    labels.
    """
    required = matchers.select(
        "ord", "source", F.size("required").alias("needed"), F.explode("required").alias("name", "value")
    )
    distinct = label_sets.select(S.labels_json(F.col("labels")).alias("label_key"), "labels")
    distinct = distinct.groupBy("label_key").agg(F.any_value("labels").alias("labels"))
    pairs = distinct.select("label_key", F.explode("labels").alias("name", "value"))
    hits = pairs.join(required, ["name", "value"]).groupBy("label_key", "ord", "source", "needed")
    full = hits.agg(F.count("*").alias("found")).filter(F.col("found") == F.col("needed"))
    undemanding = matchers.filter(F.size("required") == 0).agg(F.min(F.struct("ord", "source")).alias("m"))
    every = distinct.select("label_key", undemanding.scalar().alias("m")).select("label_key", "m.ord", "m.source")
    full = full.select("label_key", "ord", "source").unionByName(every.filter(F.col("ord").isNotNull()))
    return full.groupBy("label_key").agg(F.min_by("source", "ord").alias("source"))


def loki_log_lines(bodies: DataFrame, matchers: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Loki pushes: lines of streams whose labels match a source; line_number counts them per body from 0.

    The pushed timestamps are not used. Everything happens within the row of the body, without a shuffle.
    """
    keys = _keys(bodies, "body")
    streams = F.from_json("body", schemas.LOKI_PUSH)["streams"]

    def lines(stream: Column) -> Column:
        labels = F.coalesce(stream["stream"], F.create_map().cast("map<string,string>"))
        values = F.filter(stream["values"], lambda v: (F.size(v) >= 2) & (F.get(v, 1) != ""))
        source = source_of_labels(labels, matchers)
        return F.transform(values, lambda v: F.struct(source.alias("source"), F.get(v, 1).alias("line")))

    matched = F.filter(F.flatten(F.transform(streams, lines)), lambda entry: entry["source"].isNotNull())
    flat = bodies.select(*keys, F.posexplode(matched).alias("line_number", "l"))
    return flat.select(*keys, "l.source", F.col("line_number").cast("bigint").alias("line_number"), "l.line")


def _attributes(attributes: Column) -> Column:
    pairs = F.transform(
        F.coalesce(attributes, F.array()),
        lambda a: F.struct(
            F.coalesce(a["key"], F.lit("")), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], F.lit(""))
        ),
    )
    # a repeated key keeps its last value
    last = F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["col1"] == p["col1"])
    )
    return F.map_from_entries(last)


def otlp_metric_samples(bodies: DataFrame, received_at: Column) -> DataFrame:
    """OTLP metric exports: one sample per data point of gauges and sums, stamped with the time of receipt."""
    keys = _keys(bodies, "body")
    parsed = F.from_json("body", schemas.OTLP_METRICS)
    resources = bodies.select(*keys, received_at.alias("timestamp"), F.explode(parsed["resourceMetrics"]).alias("rm"))
    service = F.element_at(_attributes(F.col("rm.resource.attributes")), "service.name")
    resources = resources.withColumn("source", F.coalesce(service, F.lit(DEFAULT_OTEL_SOURCE)))
    metrics = F.flatten(F.transform("rm.scopeMetrics", lambda scope: scope["metrics"]))
    exploded = resources.select(*keys, "timestamp", "source", F.explode(metrics).alias("m"))
    named = exploded.filter(F.col("m.name") != "")
    gauge = F.col("m.gauge").isNotNull()
    points = F.when(gauge, F.col("m.gauge.dataPoints")).otherwise(F.col("m.sum.dataPoints"))
    samples = named.select(
        *keys,
        F.col("m.name").alias("name"),
        "timestamp",
        F.when(gauge, "gauge").otherwise("counter").alias("metric_type"),
        "source",
        F.explode(points).alias("p"),
    )
    # a double of zero counts as missing, then the integer is taken
    as_double = F.when(F.col("p.asDouble") != 0, F.col("p.asDouble"))
    value = F.coalesce(as_double, F.col("p.asInt").try_cast("double"), F.lit(0.0))
    samples = samples.withColumn("labels", _attributes(F.col("p.attributes")))
    return samples.select(
        *keys,
        "name",
        S.labels_hash(F.col("labels")).alias("labels_hash"),
        S.labels_json(F.col("labels")).alias("labels"),
        value.alias("value"),
        "timestamp",
        "metric_type",
        "source",
    )
