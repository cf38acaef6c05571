"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels that count as errors, latency keys in the order in which the first present one decides,
# severities for alert routing and for correlation.
ERROR_LEVELS = ("error", "fatal")
LATENCY_KEYS = ("latency", "duration", "response_time", "elapsed", "request_time")
FEATURE_LATENCY_KEYS = ("latency", "duration", "response_time", "elapsed")
ROUTING_ORDER = {"low": 0, "medium": 1, "high": 2, "critical": 3}
CORRELATION_ORDER = {"low": 1, "medium": 2, "high": 3, "critical": 3}

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)
_NUMBER = r"(?i)^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?(e[+-]?\d+)?|\.\d+(_\d+)*(e[+-]?\d+)?|nan|inf|infinity)\s*$"


def _lookup(key: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, order in table.items():
        out = F.when(key == name, F.lit(order)).otherwise(out)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to timestamp; anything else (also a bare year or a bare time) is null."""
    iso = F.regexp_replace(text, ",", ".")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-].*)$", "$1:00$2")
    return F.when(text.rlike(_ISO), iso.try_cast("timestamp"))


def with_ingest_default(timestamp: Column, ingested_at: Column) -> Column:
    """A line without a timestamp is stamped with its arrival."""
    return F.coalesce(timestamp, ingested_at)


def to_number(text: Column) -> Column:
    """Text to double, taking exactly the texts a JSON number or a plain numeric string can have."""
    return F.when(text.rlike(_NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def last_wins(keys: Column, values: Column) -> Column:
    """Map from parallel arrays in which a repeated key keeps its last value."""

    def build(a: Column) -> Column:
        backward, distinct = F.reverse(a["k"]), F.array_distinct(F.reverse(a["k"]))
        last = F.transform(distinct, lambda k: F.element_at(a["v"], -F.array_position(backward, k).cast("int")))
        repeated = F.size(F.array_distinct(a["k"])) < F.size(a["k"])
        return F.when(repeated, F.map_from_arrays(distinct, last)).otherwise(F.map_from_arrays(a["k"], a["v"]))

    return let(F.struct(keys.alias("k"), values.alias("v")), build)


def _unwrapped(fields: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), fields, F.lit("}")), "$.v")


def decode_fields(fields: Column) -> Column:
    """JSON object text from a fields column that may have been encoded twice; null for anything else."""
    text = F.when(fields.startswith('"'), _unwrapped(fields)).otherwise(fields)
    return F.when(F.json_object_keys(text).isNotNull(), text)


def _first_present(fields: Column, keys: tuple[str, ...]) -> Column:
    text = F.when(fields.startswith('"'), _unwrapped(fields)).otherwise(fields)
    # Inside brackets, text after the object makes the whole invalid instead of being ignored.
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    objects = F.from_json(wrapped, "array<map<string,string>>", {"allowSingleQuotes": "false"})

    def pick(entries: Column) -> Column:
        out = F.lit(None).cast("string")
        for key in reversed(keys):
            out = F.when(F.map_contains_key(entries, key), entries[key]).otherwise(out)
        return out

    # a repeated key keeps its last value
    return F.get(F.transform(objects, lambda o: let(last_wins(F.map_keys(o), F.map_values(o)), pick)), 0)


def latency(fields: Column) -> Column:
    """Latency in a log's fields: the first known key decides, even if its value is no usable number."""
    text = _first_present(fields, LATENCY_KEYS)
    return let(text, lambda t: let(to_number(t), lambda v: F.when((v >= 0) & ~F.isnan(v), v)))


def feature_latency(fields: Column) -> Column:
    """The variant used in bucket features: four keys, negative values kept."""
    return let(_first_present(fields, FEATURE_LATENCY_KEYS), to_number)


def is_error(level: Column) -> Column:
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


def severity_of(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")
    )


def routing_order(severity: Column) -> Column:
    return _lookup(severity, ROUTING_ORDER, 0)


def correlation_order(severity: Column) -> Column:
    return _lookup(F.lower(F.coalesce(severity, F.lit("low"))), CORRELATION_ORDER, 1)


def confidence(delta_sec: Column, window_seconds: float, same_source: Column, left: Column, right: Column) -> Column:
    """0.4 closeness in time + 0.3 same source + 0.3 product of the severity orders, each in [0, 1]."""
    closeness = F.greatest(F.lit(0.0), 1.0 - F.abs(delta_sec) / F.lit(float(window_seconds)))
    affinity = F.when(same_source, 1.0).otherwise(0.0)
    return closeness * 0.4 + affinity * 0.3 + (left * right / 9.0) * 0.3


def event_time(detected_at: Column, timestamp: Column, as_of: Column) -> Column:
    return F.coalesce(detected_at, timestamp, as_of)


def stable_id(*parts: Column) -> Column:
    """An id that is the same on every rerun of the same input."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.left(F.sha2(F.concat_ws("|", *texts), 256), F.lit(32))


# JSON escapes by UTF-16 code unit; every other unit outside printable ASCII becomes \\uXXXX.
JSON_ESCAPES = {
    "0008": "\\b",
    "0009": "\\t",
    "000A": "\\n",
    "000C": "\\f",
    "000D": "\\r",
    "0022": '\\"',
    "005C": "\\\\",
}


def _json_string(text: Column) -> Column:
    """JSON string literal in printable ASCII."""

    def escape(unit: Column) -> Column:
        out = F.when((unit < "0020") | (unit > "007E"), F.concat(F.lit("\\u"), F.lower(unit))).otherwise(
            F.decode(F.unhex(F.substring(unit, 3, 2)), "US-ASCII")
        )
        for code, escaped in JSON_ESCAPES.items():
            out = F.when(unit == code, F.lit(escaped)).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1)
    plain = text.rlike(r"^[ !#-\[\]-~]*$")
    body = F.when(plain, text).otherwise(F.array_join(F.transform(units, escape), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def labels_json(labels: Column) -> Column:
    """Labels as a JSON object with sorted keys and ``", "`` / ``": "`` as separators."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def labels_hash(labels: Column) -> Column:
    """First 16 hex digits of the SHA-256 of :func:`labels_json`."""
    return F.left(F.sha2(labels_json(labels), 256), F.lit(16))


def name_selected(name: Column, include: list[str], exclude: list[str]) -> Column:
    """Metric name filter: any include pattern found in it (none given: all), and no exclude pattern."""

    def any_of(patterns: list[str]) -> Column:
        return name.rlike("|".join(f"(?:{p})" for p in patterns))

    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep
