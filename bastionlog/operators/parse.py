"""Line parsing: format detection and field access, all in built-in expressions.

``parse_lines`` adds one column group per grammar; ``field`` reads a named field from whichever
grammar the line follows. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.columns import literal_array, strip

# ---- fixed values: line grammars -------------------------------------------------------------
ACCESS_LOG = (
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+) [^"]+" (\d{3}) (\d+)(?: "([^"]*)" "([^"]*)")?'
)
SYSLOG = r"^([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s+(.*)$"
PLAIN_TIMESTAMP = (
    r"(?i)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"(INFO|WARN|WARNING|ALERT|ERROR|CRITICAL|DEBUG|NOTICE)\s+(.+)$"
)
KEY_VALUE = r"([a-zA-Z0-9_]+)=([^\s]+)"
ACCESS_FIELDS = ["remote_addr", "time_local", "request", "request_uri", "status", "body_bytes_sent",
                 "http_referer", "http_user_agent"]
SYSLOG_FIELDS = ["time_local", "hostname", "process", "message"]
PLAIN_FIELDS = ["timestamp", "hostname", "level", "message"]
GROUP_MARK = "\x01"
MIN_PAIRS = 3
MIN_COMMAS = 4
ISP_REQUIRED = ["timestamp", "message"]
ISP_ONE_OF = ["level", "severity", "service"]


def json_object(line: Column) -> Column:
    """Fields of a JSON object with their types, null for anything else.

    The line is read as the only element of an array, so text after the object makes it invalid.
    """
    elements = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,variant>>",
                           {"allowSingleQuotes": "false"})
    return F.when(line.startswith("{") & line.endswith("}"), F.when(F.size(elements) == 1, elements[0]))


def detect_format(line: Column, fields: Column) -> Column:
    """Name of the first grammar the trimmed line follows."""
    has = {k: F.map_contains_key(fields, k) for k in ISP_REQUIRED + ISP_ONE_OF}
    isp = has["timestamp"] & has["message"] & (has["level"] | has["severity"] | has["service"])
    signs = lambda sign: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))
    # Counting pairs tries every letter of a text; prose, which has fewer signs than pairs are asked for, is spared that.
    pairs = (signs("=") >= MIN_PAIRS) & (F.regexp_count(line, F.lit(KEY_VALUE)) >= MIN_PAIRS)
    return (
        F.when(fields.isNotNull() & isp, "isp")
        .when(fields.isNotNull(), "json")
        .when(line.rlike(ACCESS_LOG), "apache_or_nginx")
        .when(line.rlike(SYSLOG), "syslog")
        .when(line.rlike(PLAIN_TIMESTAMP), "plain_ts")
        .when(pairs, "key_value")
        .when((signs(",") >= MIN_COMMAS) & ~line.contains("{"), "csv")
        .otherwise("text")
    )


def _groups(pattern: str, count: int) -> Column:
    """All groups of a pattern from one match, as an array; a group that took no part is empty."""
    marked = GROUP_MARK.join(f"${i}" for i in range(1, count + 1))
    return F.split(F.regexp_replace("line", pattern.removesuffix("$") + "(?s:.*)$", marked), GROUP_MARK, -1)


def parse_lines(lines: DataFrame, message: str = "raw_message") -> DataFrame:
    """Add ``line`` (trimmed), ``line_format`` and the parallel arrays ``names``, ``values`` and, for JSON, ``numbers``.

    ``values`` are texts; ``numbers`` are those that were JSON numbers, or 1 and 0 for true and false. The first entry of a name counts. Timestamped lines put their fixed fields before the pairs found
    in the text; JSON fields and pure pair lists are reversed, because there the last value counts.
    """
    fmt = F.col("line_format")
    groups = (
        F.when(fmt == "apache_or_nginx", _groups(ACCESS_LOG, len(ACCESS_FIELDS)))
        .when(fmt == "syslog", _groups(SYSLOG, len(SYSLOG_FIELDS)))
        .when(fmt == "plain_ts", _groups(PLAIN_TIMESTAMP, len(PLAIN_FIELDS)))
    )
    pairs_in = F.when(fmt == "key_value", F.col("line")).when(fmt == "plain_ts", F.col("groups")[3])
    keys = F.regexp_extract_all(pairs_in, F.lit(KEY_VALUE), F.lit(1))
    values = F.regexp_extract_all(pairs_in, F.lit(KEY_VALUE), F.lit(2))

    typed = F.reverse(F.map_values("json_fields"))
    number = lambda v: F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$", "double"))
    numbers = F.when(fmt.isin("isp", "json"), F.transform(typed, number))
    names = (
        F.when(fmt.isin("isp", "json"), F.reverse(F.map_keys("json_fields")))
        .when(fmt == "apache_or_nginx", literal_array([*ACCESS_FIELDS, "http_method"]))
        .when(fmt == "syslog", literal_array(SYSLOG_FIELDS))
        .when(fmt == "plain_ts", F.concat(literal_array(PLAIN_FIELDS), F.col("pair_keys")))
        .when(fmt == "key_value", F.reverse("pair_keys"))
    )
    texts = (
        F.when(fmt.isin("isp", "json"), F.transform(typed, lambda v: v.cast("string")))
        .when(fmt == "apache_or_nginx", F.array_append("groups", F.col("groups")[ACCESS_FIELDS.index("request")]))
        .when(fmt == "syslog", F.col("groups"))
        .when(fmt == "plain_ts", F.concat("groups", "pair_values"))
        .when(fmt == "key_value", F.reverse("pair_values"))
    )
    return (
        lines.withColumn("line", strip(F.col(message)))
        .withColumn("json_fields", json_object(F.col("line")))
        .withColumn("line_format", detect_format(F.col("line"), F.col("json_fields")))
        .withColumn("groups", groups)
        .withColumns({"pair_keys": keys, "pair_values": values})
        .withColumns({"names": names, "values": texts, "numbers": numbers})
        .drop("json_fields", "groups", "pair_keys", "pair_values")
    )


def field(name: str) -> Column:
    """Value of a named field of the line, null when it has none."""
    return F.expr(f"get(values, cast(array_position(names, '{name}') as int) - 1)")


def number(name: str) -> Column:
    """A named field that was a number or a truth value in JSON, else null."""
    return F.expr(f"get(numbers, cast(array_position(names, '{name}') as int) - 1)")


def truthy(name: str) -> Column:
    """A field's text unless its JSON value is zero or false."""
    return F.when(F.coalesce(number(name), F.lit(1.0)) != 0, field(name))


def normalised(name: str, default: Column) -> Column:
    """A field that JSON or pair keys may overwrite (``raw_message``, ``format``)."""
    overwritten = F.col("line_format").isin("isp", "json", "key_value")
    return F.coalesce(F.when(overwritten, field(name)), default)


def strptime_formats(text: Column) -> Column:
    """ISO text of a timestamp in one of the three accepted layouts, else null.

    The layout is picked by its separators first: a failed parse costs far more than a look.
    """
    squeezed = F.regexp_replace(text, r"\s+", " ")
    dashed = F.substring(text, 5, 1) == "-"
    iso = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    plain = F.try_to_timestamp(squeezed, F.lit("yyyy-MM-dd HH:mm:ss"))
    access = F.try_to_timestamp(squeezed, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    local = F.when(dashed, F.when(F.substring(text, 11, 1) == "T", iso).otherwise(plain))
    return F.coalesce(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(F.when(~dashed, access), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    )


def timestamp_text() -> Column:
    """The ``timestamp`` field: JSON and pair lists keep it verbatim, the other grammars parse it."""
    fmt = F.col("line_format")
    return (
        F.when(fmt == "apache_or_nginx", strptime_formats(field("time_local")))
        .when(fmt == "plain_ts", strptime_formats(field("timestamp")))
        .when(fmt.isin("isp", "json", "key_value"), field("timestamp"))
    )


def event_time(text: Column, fallback: Column) -> Column:
    """Instant of an ISO timestamp in UTC; unreadable text falls back to the ingest time."""
    parsed = F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.coalesce(parsed, fallback)


def csv_fields(lines: DataFrame) -> DataFrame:
    """Trimmed comma-separated parts of CSV lines; quotes have no meaning."""
    parts = F.transform(F.split("line", ",", -1), strip)
    return parse_lines(lines).filter(F.col("line_format") == "csv").withColumn("csv_fields", parts)


def simple_line(lines: DataFrame, pattern: str, message: str = "raw_message") -> DataFrame:
    """``time level source - text`` lines; anything else keeps only its text."""
    text = strip(F.col(message))
    hit = text.rlike(pattern)
    group = [F.when(hit, F.regexp_extract(text, pattern, i)) for i in range(1, 5)]
    return lines.select(
        *[c for c in lines.columns if c not in ("ts", message)],
        group[0].alias("line_time"), group[1].alias("level"), group[2].alias("source"),
        F.coalesce(group[3], text).alias("message"),
    )


def split_text(documents: DataFrame, key: str, text: str, keep_numbering: bool = False) -> DataFrame:
    """One row per non-blank line of a text; a text of blanks only yields itself.

    ``keep_numbering`` counts blank lines too, starting at 1 after the outer blanks are gone.
    """
    body = strip(F.col(text)) if keep_numbering else F.col(text)
    parts = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c]"), strip)
    numbered = F.transform(parts, lambda x, i: F.struct((i + 1).cast("bigint").alias("line_number"), x.alias("line")))
    kept = F.filter(numbered, lambda s: s["line"] != "")
    if not keep_numbering:
        kept = F.transform(kept, lambda s, i: F.struct((i + 1).cast("bigint").alias("line_number"), s["line"].alias("line")))
        whole = F.array(F.struct(F.lit(1).cast("bigint").alias("line_number"), strip(F.col(text)).alias("line")))
        kept = F.when(F.size(kept) == 0, whole).otherwise(kept)
    return documents.select(key, F.inline(kept))
