"""Code-corpus scan over a table of files (``path, extension, content``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.columns import strip
from bastionlog.functions.matching import rule_hits
from bastionlog.rules.code_rules import (
    CODE_RULES,
    COMMENT_DENSITY,
    COMMENT_SHARE,
    LARGE_FILE,
    MAX_FILE_LINES,
    OPEN_TODO,
)

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines_of(content: str) -> Column:
    """Lines of a text; a final line break opens no further line."""
    # The text is split once: what a function of an array element names twice is not worked out twice.
    closed = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(F.array(F.split(content, LINE_BREAK, -1)), closed)[0]


def source_lines(files: DataFrame, outer: bool = False) -> DataFrame:
    """One row per line, numbered from 1; if ``outer``, also one without number and text for a file without lines."""
    if outer:
        files = files.filter(F.col("content").isNotNull())
    each = F.posexplode_outer if outer else F.posexplode
    return files.select("path", "extension", each(lines_of("content")).alias("position", "text")).select(
        "path", "extension", (F.col("position") + 1).cast("bigint").alias("line"), "text"
    )


def rule_rows() -> Column:
    """The rules' attributes as one literal array."""
    return F.array(*[
        F.struct(
            F.array(*[F.lit(e) for e in r.extensions]).cast("array<string>").alias("extensions"),
            F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            F.lit(r.description).alias("description"),
        )
        for r in CODE_RULES
    ])


def matched_lines(files: DataFrame, outer: bool = False) -> DataFrame:
    """Source lines with ``hits``, the numbers of the rules that match; one matching pass."""
    return source_lines(files, outer).withColumn("hits", rule_hits(F.col("text"), [r.pattern for r in CODE_RULES], ignore_case=False))


def applies(rule: Column) -> Column:
    """Whether a rule is meant for the file's language."""
    return (F.size(rule["extensions"]) == 0) | F.array_contains(rule["extensions"], F.col("extension"))


def line_issues(files: DataFrame) -> DataFrame:
    """One row per (line, rule) hit; rules of other languages are left out by extension."""
    hits = matched_lines(files).select("path", "extension", "line", "text", F.explode_outer("hits").alias("rule"))
    named = hits.filter(F.col("rule").isNotNull()).withColumn("r", F.element_at(rule_rows(), F.col("rule") + 1))
    return named.filter(applies(F.col("r"))).select(
        "path", "line", "r.category", "r.severity", "r.description", strip(F.col("text")).alias("snippet")
    )


def _file_figures() -> list[Column]:
    """Counts per file that whole-file findings rest on (partial aggregation, no collected lines)."""
    text = F.col("text")
    comment = (text.contains("#") | text.contains("//")) & text.rlike(r"^\s*(?:#|//)")
    marker = F.col("text").contains("TODO") | F.col("text").contains("FIXME")
    return [F.count("text").alias("lines"), F.count_if(comment).alias("comments"), F.coalesce(F.bool_or(marker), F.lit(False)).alias("open_todo")]


def _file_findings() -> Column:
    """Findings of a file from its figures."""

    def issue(condition: Column, facts: tuple[str, str, str, str]) -> Column:
        names = ("category", "severity", "description", "snippet")
        return F.when(condition, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, facts)]))

    return F.array_compact(F.array(
        issue(F.col("lines") > MAX_FILE_LINES, LARGE_FILE),
        issue(F.col("open_todo") & (F.col("extension") == ".py"), OPEN_TODO),
        issue(F.try_divide("comments", "lines") > COMMENT_SHARE, COMMENT_DENSITY),
    ))


def file_issues(files: DataFrame) -> DataFrame:
    """Whole-file findings."""
    counts = source_lines(files).groupBy("path", "extension").agg(*_file_figures())
    return counts.select("path", F.lit(1).cast("bigint").alias("line"), F.inline(_file_findings()))


def all_issues(files: DataFrame) -> DataFrame:
    return line_issues(files).unionByName(file_issues(files))


def issue_counts(files: DataFrame) -> DataFrame:
    """Issues per category of every file, with its line count, from one pass; clean files count zero."""
    named = {"Bug": "bugs", "Vulnerability": "vulnerabilities", "Maintainability": "maintainability_issues"}
    found = F.transform("hits", lambda i: F.element_at(rule_rows(), i + 1))
    kinds = F.transform(F.filter(found, applies), lambda r: r["category"])
    none = F.array().cast("array<string>")
    # A file without lines still has its row.
    lines = matched_lines(files, outer=True).select(
        "path", "extension", "text", F.when(F.col("text").isNotNull() & (F.size("hits") > 0), kinds).otherwise(none).alias("kinds")
    )
    counts = lines.groupBy("path", "extension").agg(
        *_file_figures(),
        F.sum(F.size("kinds")).alias("line_issues"),
        *[F.sum(F.size(F.filter("kinds", _is(k)))).alias(n) for k, n in named.items()],
    ).withColumn("whole", F.transform(_file_findings(), lambda f: f["category"]))
    return counts.select(
        "path",
        *[(F.col(n) + F.size(F.filter("whole", _is(k)))).alias(n) for k, n in named.items()],
        (F.col("line_issues") + F.size("whole")).alias("issues"),
        F.col("lines").alias("total_lines"),
    )


def _is(kind: str):
    return lambda category: category == kind


def critical_files(files: DataFrame) -> DataFrame:
    """Files a release gate would stop, with their number of critical issues; whole-file findings are never critical."""
    critical = line_issues(files).filter(F.col("severity") == "Critical")
    return critical.groupBy("path").agg(F.count("*").alias("critical_issues"))
