"""Text safety: injection and jailbreak detection, personal data, repeated steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# Limits, patterns and their order decide which verdict a text gets.
MAX_INPUT_CHARS = 4000
DETAIL_CHARS = 50
LOOP_STEPS = 3
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"disregard\s+(all\s+)?previous\s+(instructions|directions|prompts)",
    r"forget\s+(everything|all\s+previous)",
    r"new\s+instructions?\s*:",
    r"act\s+as\s+(?:if\s+you\s+(?:are|were)|a?\s*DAN)",
    r"you\s+are\s+now\s+(?:a\s+)?(?:different|new|unrestricted)",
    r"override\s+(system\s+)?prompt",
    r"bypass\s+(?:safety|restrictions|guidelines|filters)",
    r"system\s*prompt\s*:",
    r"<\s*system\s*>",
    r"\{\{.*\}\}",
    r"\[INST\]",
    r"###\s*Human:|###\s*Assistant:",
)
JAILBREAK = (
    r"\bDAN\b",
    r"jailbreak",
    r"do\s+anything\s+now",
    r"developer\s+mode",
    r"no\s+restrictions",
    r"pretend\s+(?:you\s+have\s+no|there\s+are\s+no)\s+(?:guidelines|rules|restrictions)",
    r"roleplay\s+as\s+(?:an?\s+)?(?:evil|unrestricted|unfiltered)",
    r"hypothetically\s+speaking.*no\s+rules",
    r"in\s+a\s+fictional\s+universe.*no\s+constraints",
    r"grandma.*bedtime.*(?:recipe|formula|code)",
)
AGENT_INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"bypass\s+(?:safety|restrictions|guidelines|filters)",
    r"\bDAN\b",
)
PERSONAL = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b",
    "phone_us": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|6011\d{12}|3[47]\d{13})\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# Java flags for the meaning the patterns have on Unicode text: Unicode classes (U), only
# "\n" ends a line (d), and for the first two sets any letter case (iu).
ANY_CASE = "(?iuUd)"
AS_IS = "(?Ud)"


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Text matched by the first pattern that occurs; NULL if none does."""
    chain = F
    for p in patterns:
        chain = chain.when(text.rlike(ANY_CASE + p), F.regexp_extract(text, ANY_CASE + p, 0))
    return chain.otherwise(F.lit(None).cast("string"))


def personal_counts(text: Column) -> dict[str, Column]:
    """Number of matches per kind of personal data."""
    return {kind: F.regexp_count(text, F.lit(AS_IS + p)).cast("long") for kind, p in PERSONAL.items()}


def personal_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(AS_IS + p), F.lit(k)) for k, p in PERSONAL.items()]))


def redacted(text: Column) -> Column:
    """Personal data replaced by kind, in fixed order; a kind is only replaced where the
    original text had it."""
    out = text
    for kind, p in PERSONAL.items():
        out = F.when(text.rlike(AS_IS + p), F.regexp_replace(out, AS_IS + p, f"[{kind.upper()}_REDACTED]")).otherwise(out)
    return out


def check_text(df: DataFrame, text: str = "text", max_chars: int | None = MAX_INPUT_CHARS) -> DataFrame:
    """Add ``passed, threat_type, severity, detail, sanitized``; the first finding decides.

    A text of more than ``max_chars`` characters gets that verdict and is not searched;
    ``None`` searches texts of any length. A projection without state or shuffle, the same
    on batches and streams.
    """
    t = F.col(text)
    staged = df.withColumn("_empty", F.coalesce(strip(t), F.lit("")) == "").withColumn(
        "_long", F.lit(False) if max_chars is None else F.coalesce(F.length(t) > max_chars, F.lit(False))
    )
    open_ = ~F.col("_empty") & ~F.col("_long")
    staged = staged.withColumn("_injection", F.when(open_, first_match(t, INJECTION)))
    staged = staged.withColumn("_jailbreak", F.when(open_ & F.col("_injection").isNull(), first_match(t, JAILBREAK)))
    clean = open_ & F.col("_injection").isNull() & F.col("_jailbreak").isNull()
    staged = staged.withColumn("_kinds", F.when(clean, personal_kinds(t)))
    threat = (
        F.when(F.col("_empty"), "empty_input")
        .when(F.col("_long"), "input_too_long")
        .when(F.col("_injection").isNotNull(), "prompt_injection")
        .when(F.col("_jailbreak").isNotNull(), "jailbreak")
        .when(F.size("_kinds") > 0, "pii")
    )
    quoted = F.transform("_kinds", lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    detail = (
        F.when(F.col("_empty"), "Input is empty")
        .when(F.col("_long"), f"Input exceeds {max_chars} characters")
        .when(F.col("_injection").isNotNull(), F.concat(F.lit("Prompt injection detected: '"), F.substring("_injection", 1, DETAIL_CHARS), F.lit("'")))
        .when(F.col("_jailbreak").isNotNull(), F.concat(F.lit("Jailbreak attempt detected: '"), F.substring("_jailbreak", 1, DETAIL_CHARS), F.lit("'")))
        .when(F.size("_kinds") > 0, F.concat(F.lit("PII detected and redacted: ["), F.array_join(quoted, ", "), F.lit("]")))
    )
    named = staged.withColumn("threat_type", threat)
    severity = (
        F.when(F.col("threat_type").isin("prompt_injection", "jailbreak"), "critical")
        .when(F.col("threat_type").isin("input_too_long", "pii"), "warn")
        .otherwise("info")
    )
    return named.select(
        *df.columns,
        (F.col("threat_type").isNull() | (F.col("threat_type") == "pii")).alias("passed"),
        "threat_type",
        severity.alias("severity"),
        detail.alias("detail"),
        F.when(F.col("threat_type") == "pii", redacted(t)).alias("sanitized"),
    )


def sanitize(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data redacted in every text, whatever else the text holds."""
    return df.withColumn(text, redacted(F.col(text)))


def agent_injection(text: Column) -> Column:
    """True if one of the few agent patterns occurs."""
    found = F.lit(False)
    for p in AGENT_INJECTION:
        found = found | text.rlike(ANY_CASE + p)
    return F.coalesce(found, F.lit(False))


def detect_loops(
    steps: DataFrame, run: str, order: Sequence[str], tool: str, arguments: str, count: int = LOOP_STEPS
) -> DataFrame:
    """Per run: are its last ``count`` steps the same tool with the same arguments?

    Only the last ``count`` steps of a run per task reach the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(run).orderBy(*[F.desc(c) for c in order]))
    last = steps.withColumn("_place", place).where(F.col("_place") <= count)
    call = F.struct(F.coalesce(tool, F.lit("")), F.coalesce(arguments, F.lit("")))
    same = (F.count("*") == count) & (F.min(call) == F.max(call))
    return last.groupBy(run).agg(same.alias("looping"))


def audit_counts(checked: DataFrame) -> DataFrame:
    """Audit events by type and severity."""
    return checked.groupBy(F.coalesce("threat_type", F.lit("message")).alias("event_type"), "severity").agg(F.count("*").alias("events"))
