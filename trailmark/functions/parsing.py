"""Review replies (free text with NAME: value fields) into typed structs.

Every field is searched without an anchor, ignoring case; a missing field takes its default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _find(text: Column, pattern: str) -> Column:
    """First captured group, or NULL."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def word(text: Column, name: str, choices: str, default: str | None) -> Column:
    hit = F.upper(_find(text, rf"(?i){name}:\s*({choices})"))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def number(text: Column, name: str, decimals: bool = True) -> Column:
    digits = r"\d+(?:\.\d+)?" if decimals else r"\d+"
    return _find(text, rf"(?i){name}:\s*({digits})").cast("double")


def block(text: Column, name: str, *stops: str) -> Column:
    """Text after NAME: up to the first of the given fields or the end, trimmed."""
    ends = "|".join([f"{s}:" for s in stops] + [r"\z"])
    return _find(text, rf"(?is){name}:\s*(.+?)\s*(?:{ends})")


def items(text: Column, name: str, stops: list[str], nothing: list[str]) -> Column:
    """Comma-separated block as an array without blanks; an empty array for 'none' answers."""
    raw = block(text, name, *stops)
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    blank = raw.isNull() | F.lower(raw).isin(nothing)
    return F.when(blank, F.array().cast("array<string>")).otherwise(parts)


def flag(text: Column, name: str) -> Column:
    return word(text, name, "YES|NO", "NO") == "YES"


def parse_artifact_reply(text: Column) -> dict[str, Column]:
    return {
        "score": F.coalesce(number(text, "SCORE"), F.lit(5.0)),
        "reasoning": F.coalesce(block(text, "REASONING", "CONFIDENCE"), F.lit("")),
        "confidence": word(text, "CONFIDENCE", "LOW|MEDIUM|HIGH", "MEDIUM"),
    }


def parse_celebrity_reply(text: Column) -> dict[str, Column]:
    person = block(text, "LIKELY_PERSON", "NEWS_CONTEXT")
    return {
        "detected": flag(text, "CELEBRITY_DETECTED"),
        "person": F.when(F.lower(person) != "unknown", person),
        "context": F.coalesce(block(text, "NEWS_CONTEXT", "RISK_LEVEL"), F.lit("")),
        "risk_level": word(text, "RISK_LEVEL", "LOW|MEDIUM|HIGH", "LOW"),
    }


def parse_news_reply(text: Column) -> dict[str, Column]:
    return {
        "matches": F.coalesce(number(text, "NEWS_MATCHES", False).cast("int"), F.lit(0)),
        "sources": items(text, "SOURCES", ["VERDICT"], ["none"]),
        "verdict": word(text, "VERDICT", "CONFIRMED_REAL|CONFIRMED_FAKE|UNKNOWN", "UNKNOWN"),
        "reasoning": F.coalesce(block(text, "REASONING", "CONFIDENCE"), F.lit("")),
        "confidence": word(text, "CONFIDENCE", "LOW|MEDIUM|HIGH", "LOW"),
    }


def parse_personality_reply(text: Column) -> dict[str, Column]:
    who = block(text, "IDENTITY", "CONFIDENCE", "CATEGORY", "REASONING")
    nobody = F.lower(who).isin("unknown", "unknown person", "none")
    categories = "POLITICIAN|CELEBRITY|BUSINESS|SPORTS|MEDIA|RELIGIOUS|OTHER|UNKNOWN"
    return {
        "detected": flag(text, "PERSON_IDENTIFIED"),
        "identity": F.when(~nobody, who),
        "confidence": word(text, "CONFIDENCE", "LOW|MEDIUM|HIGH", "LOW"),
        "category": word(text, "CATEGORY", categories, "UNKNOWN"),
        "reasoning": F.coalesce(block(text, "REASONING"), F.lit("")),
    }


def parse_verdict_reply(text: Column) -> dict[str, Column]:
    said = word(text, "IS_DEEPFAKE", "YES|NO|UNCERTAIN", None)
    none = ["none", "none detected"]
    confidence = F.greatest(
        F.lit(0.0), F.least(F.lit(100.0), F.coalesce(number(text, "CONFIDENCE", False), F.lit(50)))
    )
    score = F.greatest(
        F.lit(0.0), F.least(F.lit(10.0), F.coalesce(number(text, "AUTHENTICITY_SCORE"), F.lit(5)))
    )
    return {
        "is_deepfake": F.when(said == "YES", True).when(said == "NO", False),
        "confidence": confidence.cast("int"),
        "authenticity_score": score,
        "reasoning": F.coalesce(
            block(
                text, "REASONING", "RED_FLAGS", "TECHNICAL_ARTIFACTS", "ARTIFACTS_FOUND",
                "CONTEXTUAL_ISSUES",
            ),
            F.lit(""),
        ),
        "red_flags": items(
            text, "RED_FLAGS", ["TECHNICAL_ARTIFACTS", "CONTEXTUAL_ISSUES", "RECOMMENDATION"], none
        ),
        "technical_artifacts": items(
            text, "TECHNICAL_ARTIFACTS", ["CONTEXTUAL_ISSUES", "RECOMMENDATION"],
            ["none", "none found"],
        ),
        "contextual_issues": items(
            text, "CONTEXTUAL_ISSUES", ["RECOMMENDATION"], ["none", "none found"]
        ),
        "artifacts": items(text, "ARTIFACTS_FOUND", ["QUALITY_ASSESSMENT", "RECOMMENDATION"], none),
        "recommendation": word(text, "RECOMMENDATION", "TRUST|VERIFY|REJECT", "VERIFY"),
    }


INDICATORS = [
    "LIP_SYNC_ISSUES",
    "FACE_BLENDING_ARTIFACTS",
    "LIGHTING_INCONSISTENCIES",
    "TEMPORAL_ANOMALIES",
    "TEXTURE_ABNORMALITIES",
]


def parse_verifier_reply(text: Column) -> dict[str, Column]:
    out = {
        "verdict": word(text, "VERDICT", "REAL|FAKE|UNCERTAIN", "UNCERTAIN"),
        "confidence": F.coalesce(number(text, "CONFIDENCE", False), F.lit(50)).cast("int"),
        "manipulation_score": F.coalesce(number(text, "MANIPULATION_SCORE"), F.lit(5.0)),
    }
    out |= {name.lower(): flag(text, name) for name in INDICATORS}
    out["reasoning"] = F.coalesce(block(text, "REASONING", "DETAILED_ANALYSIS"), F.lit(""))
    out["detailed_analysis"] = F.coalesce(block(text, "DETAILED_ANALYSIS"), F.lit(""))
    return out
