"""Secret scans with an incremental ledger of blobs; DataFrame functions only.

Every version of every path is a row (path, text). Its text is addressed by content: the SHA-256 of its
UTF-8 bytes is the blob. A ledger keeps what was found in a blob by a version of the rules. A scan takes
the pairs of blob and rule version that the ledger lacks, reads each such blob once however many paths
hold it, and adds the findings (also those of blobs with none) to the ledger. Findings are then joined
back to all paths of the blob.

Positions come from splitting: the pieces between a rule's matches and the matches themselves alternate,
so a running sum of their lengths is where each begins. The running sum is a window over the matches of a
blob, in proportion to their number.

Cases: null and empty texts are one empty blob without findings. Repeated rows each give a row. A null
path has its row. Matches that fail their rule's least length are dropped after matching, so what they
covered is not looked at again. Columns other than path and text are not looked at; whole texts are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The base rules in their order, with least lengths of the whole match or of a group.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of hex digits of 16 or more: shorter runs fail, and a match is always a whole run.
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Rules of a later version; their spans are added to those of the base.
ADDED_RULES = (
    # Up to the END line, past the few dashes of header lines; without one, the whole run of base64 signs,
    # blanks and written line ends that follows.
    Rule(
        "private",
        3,
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\x20\x09-\x0D\\]*)",
        0,
        1,
    ),
    Rule("webtoken", 2, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("forge", 2, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
RULES = BASE_RULES + ADDED_RULES
SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
REDACTED = "[REDACTED]"


def blob_of(text: Column) -> Column:
    """The content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(text: Column, number: int, rule: Rule) -> Column:
    """struct(ord, gaps, found): lengths of the pieces before each match; length and test of each match."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    sizes = F.transform(found, F.char_length)
    good = F.transform(tested, lambda s: F.char_length(s) >= rule.least)
    return F.when(
        text.rlike(rule.pattern),
        F.struct(F.lit(number).alias("ord"), F.lit(rule.kind).alias("kind"), F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), good.alias("good")).alias("hits")),
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans found in ``blobs`` (blob, content, versions): blob, start, ord, end, kind.

    ``versions`` lists the rule versions a blob is still to be scanned with.
    """
    text = F.col("content")
    wanted = [
        F.when(F.array_contains("versions", rule.version), matches(text, number, rule)) for number, rule in enumerate(rules)
    ]
    by_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*wanted))).alias("m"))
    hits = by_rule.select("blob", "m.ord", "m.kind", F.posexplode("m.hits").alias("at", "hit"))
    upto = Window.partitionBy("blob", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = hits.select("blob", "ord", "kind", "hit.*", F.sum(F.col("hit.gap") + F.col("hit.size")).over(upto).cast("int").alias("end"))
    return ended.filter("good").select("blob", (F.col("end") - F.col("size")).alias("start"), "ord", "end", "kind")


def versions_of(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.lit(v) for v in sorted({r.version for r in rules})))


def unscanned(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` (blob, ...) with the rule versions the ledger lacks, those with any."""
    if ledger is None:
        return blobs.withColumn("versions", versions_of(rules))
    seen = ledger.groupBy("blob").agg(F.collect_set("version").alias("seen"))
    left = F.array_except(versions_of(rules), F.coalesce("seen", F.array().cast("array<int>")))
    return blobs.join(seen, "blob", "left").withColumn("versions", left).drop("seen").filter(F.size("versions") > 0)


def may_match(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether some rule matches in the text, by one pattern of all; false for null."""
    return F.coalesce(text.rlike("|".join(f"(?:{r.pattern})" for r in rules)), F.lit(False))


def scan_unseen(texts: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries (blob, version, spans) for ``texts`` (text), with empty spans where nothing was found.

    A blob's text travels once, and only if some rule can match in it.
    """
    addressed = texts.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("content"))
    pairs = unscanned(addressed.select("blob").distinct(), ledger, rules)
    matching = addressed.filter(may_match(F.col("content"), rules))
    once = matching.groupBy("blob").agg(F.first("content").alias("content"))
    version = F.element_at(F.array(*(F.lit(r.version) for r in rules)), F.col("ord") + 1)
    found = scan(unscanned(once, ledger, rules), rules).groupBy("blob", version.alias("version")).agg(
        F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("found")
    )
    return (
        pairs.select("blob", F.explode("versions").alias("version"))
        .join(found, ["blob", "version"], "left")
        .select("blob", "version", F.coalesce("found", F.array().cast(SPANS)).alias("spans"))
    )


def findings_by_blob(ledger: DataFrame) -> DataFrame:
    """All spans of each blob that has any, of all rule versions, sorted."""
    return ledger.filter(F.size("spans") > 0).groupBy("blob").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )


def rendered(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_findings(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what ``findings`` by blob hold: counts, digest of base spans, all spans.

    With findings from a written table the planner can split a blob that many paths hold.
    """
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    spans = F.coalesce(F.col("spans"), F.array().cast(SPANS))
    base = F.filter(spans, lambda s: s["ord"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return paths.join(findings, "blob", "left").select(
        "doc_id",
        *(count(rule.kind) for rule in BASE_RULES),
        F.sha2(rendered(base), 256).alias("base_sha256"),
        rendered(spans).alias("spans"),
    )


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with ``REDACTED`` for the secret part of every finding; private keys go first, being whole blocks."""
    for rule in sorted(rules, key=lambda r: r.kind != "private"):
        if rule.kind == "assign":
            head, value = rule.pattern.rsplit("(", 1)
            least = value.removesuffix("+)") + f"{{{rule.least},}}"
            text = F.regexp_replace(text, f"({head}){least}", "$1" + REDACTED)
        else:
            pattern = rule.pattern.removesuffix("[A-Z0-9]+") + f"[A-Z0-9]{{{rule.least - 4},}}" if rule.kind == "access" else rule.pattern
            text = F.regexp_replace(text, pattern, REDACTED)
    return text


def redact_secrets(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets of all rows that ``findings`` by blob, made with ``rules``, has spans for taken
    out of the text.

    All rows and columns stay; n_chars, where it is a column, follows the text. Only rows some rule matches in
    meet the findings in a shuffle; the others, most of a corpus, pass by it.
    """
    found = findings.select(F.col("blob").alias("_found_blob"))
    matching = may_match(docs["text"], rules)
    marked = docs.filter(matching).withColumn("_blob", blob_of(F.col("text")))
    hit = F.col("_found_blob").isNotNull()
    clean = marked.join(found, marked["_blob"] == found["_found_blob"], "left").withColumn(
        "text", F.when(hit, redacted(F.col("text"), rules)).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(hit, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return clean.select(*names).unionAll(docs.filter(~matching).select(*names))
