"""Validation, quality, relevance and the acceptance funnel of submissions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import text
from evenkeel.operators import activity, admission

# Length bounds and spam rules.
TITLE_MIN, TITLE_MAX = 5, 200
DESCRIPTION_MIN, DESCRIPTION_MAX = 10, 5000
REPEATED = r"(.)\1{20,}"
FOREIGN_LINK = r"https?://(?!github\.com)"
PROMOTION = r"(?U)\b(buy|sell|click here|subscribe|download now)\b"
SHOUTING = r"[A-Z]{50,}"

# Words that lower the quality score.
VAGUE_WORDS = (
    "something", "somehow", "maybe", "sometimes", "stuff",
    "things", "whatever", "kind of", "sort of", "etc",
    "and so on", "or something", "i think", "probably",
)
# Elements a submission of each type should mention.
REQUIRED = {
    "bug": ("what happened", "expected behavior", "actual behavior"),
    "feature": ("what feature", "why needed", "expected behavior"),
    "improvement": ("what to improve", "why", "expected outcome"),
}
# Signals that raise the quality score.
STRUCTURE_WORDS = ("steps to reproduce", "expected", "actual", "should be", "currently")
EXAMPLE_WORDS = ("example", "for instance", "specifically", "when i")
STEP_MARKS = ("1.", "2.", "step 1", "step 2", "\n-", "\n*")
# A lower-case word start, 30 or more lower-case letters and blanks, then a full
# stop. Only the first word start of such a run can match, so each run is read once.
LONG_LOWERCASE = r"(?U)(?<![a-z\s])(?>[a-z\s]*?\b[a-z])[a-z\s]{30,}+[.!?]"
# Where the score starts, what each finding adds, and the bands.
START, VAGUE, DETAILS, GRAMMAR, SIGNAL = 7, -2, -3, -1, 2
GOOD_SCORE, FAIR_SCORE = 7, 4
# Findings and suggestions.
SHORT = ("Description is very short (less than 50 characters)", "Add more details to help us understand the issue")
UNCAPITALISED = ("May have grammar issues (missing capitalization)", "Check capitalization and punctuation")
NO_BREAKS = ("No sentence breaks in description", "Break text into clear sentences")
BE_SPECIFIC = "Be more specific - avoid words like 'something', 'somehow', 'maybe'"

# On-topic and off-topic words.
TOPIC_WORDS = (
    "query", "sql", "database", "table", "column", "index", "performance",
    "execution", "plan", "optimize", "oracle", "mysql", "postgresql", "slow",
    "timeout", "analyze", "explain", "cache", "schema", "join", "select",
)
OFFTOPIC_WORDS = (
    "pizza", "lyrics", "song", "poem", "joke", "game", "weather",
    "recipe", "music", "movie", "crypto", "lottery", "horoscope",
    "dance", "sing", "fly", "teleport", "magic", "puzzle",
)

# How the reason of a category begins; the words or their number follow.
OFFTOPIC_REASON = "words off the topic: "
TOPIC_REASON = "words on the topic: "


def _known(name: str) -> Column:
    """A text column; NULL reads as an empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def _combined(title: str, description: str) -> Column:
    return F.lower(F.concat(_known(title), F.lit(" "), _known(description)))


def validate(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Add ``invalid_reason``: the first failing length or spam rule, NULL when fine."""
    low = _combined(title, description)
    raw = F.concat(_known(title), F.lit(" "), _known(description))
    n_title, n_description = F.length(_known(title)), F.length(_known(description))
    reason = (
        F.when(n_title > TITLE_MAX, "title too long")
        .when(n_title < TITLE_MIN, "title too short")
        .when(n_description > DESCRIPTION_MAX, "description too long")
        .when(n_description < DESCRIPTION_MIN, "description too short")
        .when(low.rlike(REPEATED), "repeated characters")
        .when(low.rlike(FOREIGN_LINK), "external links")
        .when(low.rlike(PROMOTION), "promotional content")
        .when(raw.rlike(SHOUTING), "excessive caps")
    )
    return df.withColumn("invalid_reason", reason)


def _missing_elements(kind: Column, low: Column) -> Column:
    """Required elements of the type none of whose words occurs."""

    def absent(elements: Sequence[str]) -> Column:
        return F.array_compact(
            F.array(*[F.when(~text.any_contained(low, e.split()), e) for e in elements])
        )

    pick = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, elements in REQUIRED.items():
        pick = pick.when(kind == name, absent(elements))
    return pick.otherwise(F.array().cast("array<string>"))


def quality(
    df: DataFrame, kind: str = "issue_type", title: str = "title", description: str = "description"
) -> DataFrame:
    """Add ``quality_score`` (0 to 10), ``severity``, ``needs_improvement``, ``vague_word_count``,
    ``issues_found`` and ``suggestions``."""
    body = _known(description)
    rows = df.withColumn("_low", _combined(title, description))
    low = F.col("_low")
    rows = rows.withColumns(
        {"_vague": text.contained(low, VAGUE_WORDS), "_missing": _missing_elements(F.col(kind), low)}
    )
    vague, missing = F.col("_vague"), F.col("_missing")
    is_vague, is_short, lacks = vague > 3, F.length(body) < 50, F.size(missing) > 0
    uncapitalised = body.rlike(LONG_LOWERCASE)
    unbroken = ~body.contains(".") & (F.length(body) > 50)

    def add(condition: Column, weight) -> Column:
        return F.when(condition, weight).otherwise(0)

    score = (
        F.lit(START)
        + add(is_vague, F.least(vague, F.lit(3)) * VAGUE)
        + add(is_short, DETAILS)
        + add(lacks, DETAILS)
        + add(uncapitalised, GRAMMAR)
        + add(unbroken, GRAMMAR)
        + add(text.any_contained(low, STRUCTURE_WORDS), SIGNAL)
        + add(text.any_contained(body, STEP_MARKS), SIGNAL)
        + add(text.any_contained(low, EXAMPLE_WORDS), SIGNAL)
    )
    listed = F.array_join(missing, ", ")
    found = F.array(
        F.when(
            is_vague,
            F.concat(F.lit("Contains "), vague.cast("string"), F.lit(" vague words (something, maybe, etc.)")),
        ),
        F.when(is_short, SHORT[0]),
        F.when(lacks, F.concat(F.lit("Missing key information: "), listed)),
        F.when(uncapitalised, UNCAPITALISED[0]),
        F.when(unbroken, NO_BREAKS[0]),
    )
    suggested = F.array(
        F.when(is_vague, BE_SPECIFIC),
        F.when(is_short, SHORT[1]),
        F.when(lacks, F.concat(F.lit("Please describe: "), listed)),
        F.when(uncapitalised, UNCAPITALISED[1]),
        F.when(unbroken, NO_BREAKS[1]),
    )
    rows = rows.withColumns(
        {
            "quality_score": F.greatest(F.lit(0), F.least(F.lit(10), score)).cast("double"),
            "issues_found": F.array_compact(found),
            "suggestions": F.array_compact(suggested),
        }
    )
    points = F.col("quality_score")
    severity = F.when(points >= GOOD_SCORE, "low").when(points >= FAIR_SCORE, "medium").otherwise("high")
    more = {
        "severity": severity,
        "needs_improvement": points < GOOD_SCORE,
        "vague_word_count": F.when(vague > 3, vague).otherwise(0).cast("long"),
    }
    return rows.withColumns(more).drop("_low", "_vague", "_missing")


def relevance(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Add ``category`` (offtopic, relevant, unclear, irrelevant), ``confidence``, ``is_relevant`` and
    ``relevance_reason``, which names the off-topic words found or counts those on topic."""
    low = _combined(title, description)
    rows = df.withColumns(
        {"_on": text.whole_words(low, TOPIC_WORDS), "_off": text.words_found(low, OFFTOPIC_WORDS)}
    )
    on, off = F.col("_on"), F.size("_off")
    category = (
        F.when(off > 0, "offtopic").when(on >= 2, "relevant").when(on == 1, "unclear").otherwise("irrelevant")
    )
    confidence = F.when(off > 0, 0.9).when(on >= 2, 0.8).when(on == 1, 0.6).otherwise(0.9)
    # in the order of the word list
    found = F.filter(F.array(*map(F.lit, OFFTOPIC_WORDS)), lambda w: F.array_contains("_off", w))
    reason = F.when(off > 0, F.concat(F.lit(OFFTOPIC_REASON), F.array_join(found, ", "))).otherwise(
        F.concat(F.lit(TOPIC_REASON), on.cast("string"))
    )
    return (
        rows.withColumn("category", category)
        .withColumn("confidence", confidence)
        .withColumn("is_relevant", F.col("category") == "relevant")
        .withColumn("relevance_reason", reason)
        .drop("_on", "_off")
    )


def labels(kind: Column, score: Column, good: float = GOOD_SCORE, fair: float = FAIR_SCORE) -> Column:
    """Labels of a submission from its type and quality score."""
    grade = F.when(score >= good, "good-quality").when(score < fair, "needs-clarification")
    return F.array_compact(F.array(kind, F.lit("user-submitted"), grade))


def stages(
    df: DataFrame,
    ts: str = "created_at",
    limits: Mapping[str, tuple[int, int]] | None = None,
    min_score: float = 0.0,
) -> DataFrame:
    """id, session, client, time and ``stage``: where a submission stops, in the order rate,
    content, relevance, duplicate, quality; else accepted.

    Rows are taken in order of time and id, and only accepted ones use quota of their
    session and client or make later ones duplicates. Texts are judged first and left
    behind, so only narrow rows are shuffled and sorted.
    """
    limits = limits or {}
    quota = admission.Quota(
        session=limits.get("session", (activity.SESSION_PER_HOUR, activity.SESSION_PER_DAY)),
        client=limits.get("client", (activity.CLIENT_PER_HOUR, activity.CLIENT_PER_DAY)),
        duplicate_minutes=activity.DUPLICATE_MINUTES,
    )
    rows = quality(relevance(validate(df)))
    stop = F.when(F.col("invalid_reason").isNotNull(), "content").when(~F.col("is_relevant"), "relevance")
    title, description = (F.coalesce(c, F.lit("")) for c in ("title", "description"))
    judged = rows.select(
        "id",
        "session_id",
        "client_id",
        ts,
        text.content_hash(title, description).alias("content_hash"),
        stop.alias("stop"),
        (F.col("quality_score") < min_score).alias("poor"),
    )
    return admission.decided(judged, quota, ts)


def staged(
    df: DataFrame,
    ts: str = "created_at",
    limits: Mapping[str, tuple[int, int]] | None = None,
    min_score: float = 0.0,
) -> DataFrame:
    """Add ``stage`` (see ``stages``) to the submissions; their ids must be unique."""
    found = stages(df, ts, limits, min_score).select("id", "stage")
    return df.join(found, "id")


def funnel(staged_rows: DataFrame) -> DataFrame:
    """How many submissions stop at each stage."""
    return staged_rows.groupBy("stage").agg(F.count("*").alias("submissions"))
