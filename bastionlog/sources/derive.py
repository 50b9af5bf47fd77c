"""Tables derived from the supplied ``events`` table: log lines, health snapshots, source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.functions.columns import choose, literal, literal_array
from bastionlog.operators.parse import split_text
from bastionlog.sources.templates import (
    BURST_EVENTS,
    BURST_SECONDS,
    HOT_HOSTS,
    LINES_PER_SECOND,
    LONG_SNIPPET_EVERY,
    LONG_SNIPPET_LINES,
    SNIPPETS,
    STREAMS,
    EXPECTED,
    TEMPLATES,
)

INPUT_PARTITIONS = "bastionlog.input.partitions"
#: Events a task turns into lines or files at most: a row of a few bytes becomes one of hundreds, so the
#: size of their files says little about the work.
EVENTS_PER_TASK = 100_000
#: Numbers kept free for the lines of a conversation turn.
LINES_PER_TURN = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table. A session that names ``INPUT_PARTITIONS`` deals its rows out to so many tasks: for
    test tables of one small file; large tables have partitions of their own."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    count = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(count)) if count else rows


def spread_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of the events, dealt out to tasks by their values; how many tasks, the number of rows says
    (read from the files' footers)."""
    events = table(spark, sf_dir, "events")
    tasks = -(-events.count() // EVENTS_PER_TASK)
    rows = events.select(*columns)
    return rows.repartition(tasks, *columns) if tasks > 1 else rows


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_index, stream_id, ts, raw_message``, one line per event.

    Events come in hourly bursts and a third of the users share eight addresses, so sources repeat
    within the deduplication window and a few of them are hot.
    """
    user = F.col("user_id")
    seconds = (
        F.expr(f"event_id div {BURST_EVENTS}") * BURST_SECONDS
        + F.expr(f"(event_id % {BURST_EVENTS}) div {LINES_PER_SECOND}")
    )
    base = (
        spread_events(spark, sf_dir, "event_id", "user_id")
        .withColumn("seconds", seconds)
        .withColumn("ts", F.expr("timestampadd(SECOND, seconds, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
        .withColumn("host", F.when(user % 3 == 0, user % HOT_HOSTS).otherwise(user))
    )
    fields = {
        "ip": F.concat(
            F.lit("10."), (user % STREAMS).cast("string"), F.lit("."),
            F.expr("host div 256").cast("string"), F.lit("."), (F.col("host") % 256).cast("string"),
        ),
        "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "plain": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "clf": F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss' +0000'"),
        "syslog": F.date_format("ts", "MMM d HH:mm:ss"),
        "n": (F.col("event_id") % 97).cast("string"),
        "u": user.cast("string"),
    }
    shape = (F.col("event_id") % len(TEMPLATES) + 1).cast("int")
    message = F.element_at(literal_array(TEMPLATES), shape)
    for name, value in fields.items():
        message = F.replace(message, F.lit("{" + name + "}"), value)
    return base.select(
        F.col("event_id").alias("line_index"),
        (user % STREAMS).alias("stream_id"),
        "ts",
        message.alias("raw_message"),
    )


def given_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the supplied tables hold as log input: each event written out as a JSON line with its own values,
    and every line of every document, page and conversation turn as it stands.

    A user's events are a stream, as is each document, page and conversation; streams of the four tables
    differ in their number modulo 4. Texts carry no time and take the first of 2024.
    """
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    event = F.concat(
        F.lit('{"timestamp":"'), stamp, F.lit('","level":"'), F.coalesce("event_type", F.lit("")),
        F.lit('","customer_id":'), F.coalesce(F.col("user_id").cast("string"), F.lit("null")),
        F.lit(',"usage_mbps":'), F.coalesce(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("null")),
        F.lit(',"message":"'), F.coalesce("event_type", F.lit("")),
        F.lit('","props":'), F.coalesce("props", F.lit("null")), F.lit("}"),
    )
    lines = spread_events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value", "props").select(
        F.col("event_id").alias("line_index"), (F.col("user_id") * 4).alias("stream_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), event.alias("raw_message"),
    )
    number = F.lit(0).cast("bigint")
    for place, (name, key, text, order) in enumerate(
        [("documents", "doc_id", "text", number), ("pages", "page_id", "html", number), ("conversations", "conv_id", "text", F.col("turn"))], 1
    ):
        texts = table(spark, sf_dir, name).select(F.struct((F.col(key) * 4 + place).alias("s"), order.alias("t")).alias("at"), F.col(text).alias("text"))
        lines = lines.unionByName(split_text(texts, "at", "text").select(
            (F.col("at.t") * LINES_PER_TURN + F.col("line_number")).alias("line_index"), F.col("at.s").alias("stream_id"),
            F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("ts"), F.col("line").alias("raw_message"),
        ))
    return lines


def expected_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_index, label``: the threat each log line was written to show, or ``benign``."""
    cases = [(number, literal(threat)) for number, threat in EXPECTED.items()]
    label = choose(f"event_id % {len(TEMPLATES)}", cases, "'benign'")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_index"), label.alias("label")
    )


def system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load of each stream from the events' own values: their peak and mean as percentages, the sums of
    what was viewed or clicked and of the rest as traffic, the users as connections. Hundredths are summed whole."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    shown = F.col("event_type").isin("view", "click")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % STREAMS).alias("stream_id"), hour.alias("ts")).agg(
        F.min("event_id").alias("id"),
        F.least(F.lit(100.0), F.max(cents) / 100).alias("cpu_usage"),
        F.least(F.lit(100.0), F.sum(cents) / F.count(cents) / 100).alias("memory_usage"),
        (F.coalesce(F.sum(F.when(shown, cents)), F.lit(0)) / 100).alias("network_tx"),
        (F.coalesce(F.sum(F.when(~shown, cents)), F.lit(0)) / 100).alias("network_rx"),
        F.count_distinct("user_id").cast("int").alias("active_connections"),
    ).select("id", "stream_id", "ts", "cpu_usage", "memory_usage", "network_tx", "network_rx", "active_connections")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, extension, content``: documents, pages and one snippet per event as a corpus of source files."""
    d, p = F.col("doc_id"), F.col("page_id")
    doc_ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".js", ".java", ".ts")]), (d % 4 + 1).cast("int"))
    page_ext = F.when(p % 2 == 0, ".html").otherwise(".js")
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), d.cast("string"), doc_ext).alias("path"),
        doc_ext.alias("extension"), F.col("text").alias("content"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), p.cast("string"), page_ext).alias("path"),
        page_ext.alias("extension"), F.col("html").alias("content"),
    )
    kind = (F.col("event_id") % len(SNIPPETS) + 1).cast("int")
    number = F.col("event_id").cast("string")
    extension = F.element_at(literal_array([e for e, _ in SNIPPETS]), kind)
    short = F.replace(F.element_at(literal_array([t for _, t in SNIPPETS]), kind), F.lit("{n}"), number)
    long = F.repeat(F.lit("x = 1\n"), LONG_SNIPPET_LINES)
    code = spread_events(spark, sf_dir, "event_id", "user_id", "ts").select(
        F.concat(F.lit("src/"), number, extension).alias("path"), extension.alias("extension"),
        F.when(F.col("event_id") % LONG_SNIPPET_EVERY == 0, long).otherwise(short).alias("content"),
    )
    return docs.unionByName(pages).unionByName(code)
