"""Log line parsing as column expressions.

``parse_line`` gives one struct (timestamp, level, message as text, fields as JSON text, format) per line, null for
a line that cannot be parsed in its format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import last_wins, let

SAMPLE_LINES = 10
DETECTED = ("json", "nginx", "syslog3164", "logfmt")

# Patterns and key names of the supported formats.
# (?U) makes \w, \s and \S cover Unicode.
LOGFMT_LINE = r"(?U)^\w+=\S+(\s+\w+=\S+)+"
LOGFMT_PAIR = r'(?U)(\w+)=(?:"([^"]*)"|(\S+))'
JSON_LEVEL_KEYS = ("level", "severity", "lvl")
JSON_MESSAGE_KEYS = ("message", "msg", "log")
JSON_TIME_KEYS = ("timestamp", "time", "ts", "@timestamp")
LOGFMT_LEVEL_KEYS = ("level", "lvl")
LOGFMT_MESSAGE_KEYS = ("msg", "message")
LOGFMT_TIME_KEYS = ("time", "ts", "timestamp")
# Blanks that are cut off both ends of a line.
BLANKS = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Combined access log: host ident user [time] "request" status bytes "referer" "agent"; quotes inside are escaped.
QUOTED = r'"((?:[^"\\]|\\.)*)"'
ACCESS_LINE = rf"^(\S+) (\S+) (\S+) \[([^\]]+)\] {QUOTED} (\d{{3}}) (\d+|-)(?: {QUOTED} {QUOTED})?.*$"
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
# BSD syslog: <pri>Mmm dd hh:mm:ss host tag[pid]: message
SYSLOG_LINE = r"^<(\d{1,3})>([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: ?(.*)$"
SYSLOG_LEVELS = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _first_key(entries: Column, keys: tuple[str, ...]) -> Column:
    """The first of ``keys`` that the map has, as a column; null if none."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(entries, key), F.lit(key)).otherwise(out)
    return out


def _as_text(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "string")


def _without(entries: Column, gone: Column) -> Column:
    return F.to_json(F.map_filter(entries, lambda k, _: ~F.array_contains(gone, k)))


def _record(timestamp: Column, level: Column, message: Column, fields: Column, fmt: str) -> Column:
    return F.struct(
        timestamp.cast("string").alias("timestamp"),
        level.cast("string").alias("level"),
        message.cast("string").alias("message"),
        fields.alias("fields"),
        F.lit(fmt).alias("format"),
    )


def _json_objects(line: Column, value: str) -> Column:
    # Inside brackets, text after the object makes the whole invalid instead of being ignored.
    wrapped = F.concat(F.lit("["), _strip(line), F.lit("]"))
    return F.from_json(wrapped, f"array<map<string,{value}>>", {"allowSingleQuotes": "false"})


def parse_json(line: Column) -> Column:
    """Null unless the line is exactly one JSON object.

    Values keep their types. Where a nested object repeats a key, which typed values do not allow, all fields of the
    line are kept as text.
    """
    typed = _json_record(_json_objects(line, "variant"), _as_text)
    return F.coalesce(typed, _json_record(_json_objects(line, "string"), lambda value: value))


def _json_record(objects: Column, as_text: Callable[[Column], Column]) -> Column:
    def record(entries: Column) -> Column:
        keys = F.struct(
            *[
                _first_key(entries, names).alias(part)
                for part, names in (("l", JSON_LEVEL_KEYS), ("m", JSON_MESSAGE_KEYS), ("t", JSON_TIME_KEYS))
            ]
        )
        return let(
            keys,
            lambda k: _record(
                as_text(entries[k["t"]]),
                F.lower(as_text(entries[k["l"]])),
                as_text(entries[k["m"]]),
                _without(entries, F.array_compact(F.array(k["l"], k["m"], k["t"]))),
                "json",
            ),
        )

    def single(objects: Column) -> Column:
        raw = F.get(objects, 0)
        entries = last_wins(F.map_keys(raw), F.map_values(raw))
        return F.when((F.size(objects) == 1) & raw.isNotNull(), let(entries, record))

    return let(objects, single)


def parse_logfmt(line: Column) -> Column:
    def value(pair: Column) -> Column:
        text = F.substring(pair, F.instr(pair, "=") + 1, F.length(pair))
        quoted = text.startswith('"') & text.endswith('"') & (F.length(text) > 1)
        return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)

    def record(entries: Column) -> Column:
        level, message, time = (
            entries[_first_key(entries, names)] for names in (LOGFMT_LEVEL_KEYS, LOGFMT_MESSAGE_KEYS, LOGFMT_TIME_KEYS)
        )
        aliases = F.array(*[F.lit(k) for k in LOGFMT_LEVEL_KEYS + LOGFMT_MESSAGE_KEYS + LOGFMT_TIME_KEYS])
        return _record(time, level, message, _without(entries, aliases), "logfmt")

    def found(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
        return F.when(F.size(pairs) > 0, let(last_wins(keys, F.transform(pairs, value)), record))

    return let(F.regexp_extract_all(line, F.lit(LOGFMT_PAIR), F.lit(0)), found)


def parse_plain(line: Column) -> Column:
    message = _strip(line)
    nothing = F.lit(None).cast("string")
    return F.when(message != "", _record(nothing, nothing, message, F.lit("{}"), "plain"))


def _groups(line: Column, pattern: str, count: int, body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of the groups of a pattern that must match the whole line; the pattern is applied once."""
    mark = "\u0001"
    joined = F.regexp_replace(line, pattern, mark + mark.join(f"${i}" for i in range(1, count + 1)))

    def use(parts: Column) -> Column:
        groups = [F.get(parts, i) for i in range(count + 1)]
        return F.when((F.size(parts) == count + 1) & (groups[0] == ""), body(groups))

    return let(F.split(joined, mark), use)


def parse_access(line: Column) -> Column:
    """Combined (nginx, Apache) access log line; message is the request line."""

    def record(part: list[Column]) -> Column:
        request = F.split(part[5], " ")
        timestamp = F.try_to_timestamp(part[4], F.lit(ACCESS_TIME))
        status = part[6].try_cast("int")
        level = F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")
        fields = F.to_json(
            F.struct(
                part[1].alias("remote_addr"),
                F.when(part[3] != "-", part[3]).alias("remote_user"),
                F.get(request, 0).alias("method"),
                F.get(request, 1).alias("path"),
                F.get(request, 2).alias("protocol"),
                status.alias("status"),
                part[7].try_cast("bigint").alias("bytes"),
                F.when(~part[8].isin("", "-"), part[8]).alias("referer"),
                F.when(~part[9].isin("", "-"), part[9]).alias("user_agent"),
            )
        )
        iso = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ssXXX")
        return _record(iso, level, part[5], fields, "nginx")

    return _groups(line, ACCESS_LINE, 9, record)


def parse_syslog(line: Column, year: int) -> Column:
    """BSD syslog line; the format carries no year, so the caller gives it."""

    def record(part: list[Column]) -> Column:
        priority = part[1].try_cast("int")
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part[2])
        number, day = F.lpad(month.cast("string"), 2, "0"), F.lpad(part[3], 2, "0")
        iso = F.concat(F.lit(f"{year:04d}-"), number, F.lit("-"), day, F.lit("T"), part[4])
        level = F.get(F.array(*[F.lit(v) for v in SYSLOG_LEVELS]), F.pmod(priority, F.lit(8)))
        fields = F.to_json(
            F.struct(
                F.floor(priority / 8).cast("int").alias("facility"),
                F.pmod(priority, F.lit(8)).alias("severity"),
                part[5].alias("hostname"),
                part[6].alias("app"),
                F.when(part[7] != "", part[7]).alias("pid"),
            )
        )
        return F.when(month > 0, _record(iso, level, part[8], fields, "syslog3164"))

    return _groups(line, SYSLOG_LINE, 8, record)


def _bare_object(line: Column) -> Column:
    text = _strip(line)
    return text.startswith("{") & text.endswith("}")


def looks_json(line: Column) -> Column:
    parsed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    valid = (F.size(parsed) == 1) & F.get(parsed, 0).isNotNull()
    return F.coalesce(F.when(_bare_object(line), valid), F.lit(False))


def looks_logfmt(line: Column) -> Column:
    """Two or more ``key=value`` pairs from the start."""
    return F.coalesce(line.contains("=") & _strip(line).rlike(LOGFMT_LINE), F.lit(False))


def looks_access(line: Column) -> Column:
    return F.coalesce(line.contains('] "') & line.rlike(ACCESS_LINE), F.lit(False))


def looks_syslog(line: Column) -> Column:
    """A priority, a date with a known month, a host and a tag."""
    pattern = SYSLOG_LINE.replace("[A-Z][a-z]{2}", "|".join(MONTHS))
    return F.coalesce(line.startswith("<") & line.rlike(pattern), F.lit(False))


def line_format(line: Column) -> Column:
    """Format of a single line by itself."""
    return (
        F.when(looks_json(line), "json")
        .when(looks_access(line), "nginx")
        .when(looks_syslog(line), "syslog3164")
        .when(looks_logfmt(line), "logfmt")
        .otherwise("plain")
    )


def parse_line(line: Column, fmt: Column | None = None, year: int = 1970) -> Column:
    """Parse by a given format (a column, null for none), or by the format the line itself looks like."""
    own = F.coalesce(
        F.when(_bare_object(line), parse_json(line)),
        F.when(looks_access(line), parse_access(line)),
        F.when(looks_syslog(line), parse_syslog(line, year)),
        F.when(looks_logfmt(line), parse_logfmt(line)),
        parse_plain(line),
    )
    if fmt is None:
        return own
    return (
        F.when(fmt.isNull(), own)
        .when(fmt == "json", parse_json(line))
        .when(fmt == "logfmt", parse_logfmt(line))
        .when(fmt.isin("nginx", "combined"), parse_access(line))
        .when(fmt == "syslog3164", parse_syslog(line, year))
        .otherwise(parse_plain(line))
    )


def detect_format(lines: DataFrame, by: str = "source", order: str = "line_number", line: str = "line") -> DataFrame:
    """One row per ``by`` with the format that more than half of its first ten lines have, else plain.

    The rank filter is pushed below the shuffle, so at most ten lines per key and map task move.
    """
    first = Window.partitionBy(by).orderBy(order)
    sample = lines.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= SAMPLE_LINES)
    kinds = sample.select(by, line_format(F.col(line)).alias("__kind")).groupBy(by)
    share = kinds.agg(*[F.avg((F.col("__kind") == k).cast("int")).alias(f"__{k}") for k in DETECTED])
    kind = F.coalesce(*[F.when(F.col(f"__{k}") > 0.5, k) for k in DETECTED], F.lit("plain"))
    return share.select(by, kind.alias("format"))


def parse_each(lines: DataFrame, fmt: Column | None = None, line: str = "line", year: int = 1970) -> DataFrame:
    """Parse every line on its own and drop what cannot be parsed. Input: source, line_number and the line."""
    # inline() drops the unparsable and spreads the struct while the parse expression is evaluated once
    record = F.array_compact(F.array(parse_line(F.col(line), fmt, year)))
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, F.col(line).alias("raw"), F.inline(record))


def parse_batches(lines: DataFrame, by: str = "source", order: str = "line_number", line: str = "line") -> DataFrame:
    """Parse all lines of a batch in the one format found for the batch. Batches without lines have no rows."""
    formats = detect_format(lines, by, order, line).withColumnRenamed("format", "__format")
    return parse_each(lines.join(formats, by), F.col("__format"), line).drop("__format")
