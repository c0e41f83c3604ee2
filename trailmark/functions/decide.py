"""Scalar decisions: clamps, labels, gates and routes, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prefixes that mark a private or local address
PRIVATE_PREFIXES = [
    "127.", "10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "172.21.", "172.22.",
    "172.23.", "172.24.", "172.25.", "172.26.", "172.27.", "172.28.", "172.29.", "172.30.",
    "172.31.", "192.168.", "0.0.", "localhost", "::1",
]

# fixed values: transaction kinds the ledger knows; only the first may be sent in batches
BATCHABLE_KINDS = ["register_video"]
KNOWN_KINDS = [
    "register_video", "spread_event", "lineage", "first_detection_alert", "reupload_alert",
    "geo_spread_alert", "check_thresholds", "acknowledge_alert",
]

# fixed values: registered domain -> platform name
PLATFORMS = {
    "twitter.com": "Twitter",
    "x.com": "X",
    "facebook.com": "Facebook",
    "youtube.com": "YouTube",
    "tiktok.com": "TikTok",
    "instagram.com": "Instagram",
    "reddit.com": "Reddit",
    "linkedin.com": "LinkedIn",
}

# fixed values: severity order
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Value within [low, high]; NULL stays NULL."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def ladder(value: Column, rungs: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first rung the value reaches, highest rung first."""
    out = None
    for floor, label in rungs:
        out = (out if out is not None else F).when(value >= floor, label)
    return out.otherwise(otherwise)


def verdict(is_fake: Column, confidence: Column) -> Column:
    fake = ladder(
        confidence,
        [(0.9, "HIGHLY LIKELY DEEPFAKE"), (0.7, "LIKELY DEEPFAKE"), (0.5, "POSSIBLY DEEPFAKE")],
        "SUSPECTED DEEPFAKE (LOW CONFIDENCE)",
    )
    real = ladder(
        confidence,
        [(0.9, "HIGHLY LIKELY AUTHENTIC"), (0.7, "LIKELY AUTHENTIC"), (0.5, "POSSIBLY AUTHENTIC")],
        "UNCLEAR - MANUAL REVIEW RECOMMENDED",
    )
    return F.when(is_fake, fake).otherwise(real)


def confidence_level(confidence: Column) -> Column:
    rungs = [(0.9, "VERY HIGH"), (0.7, "HIGH"), (0.5, "MEDIUM"), (0.3, "LOW")]
    return ladder(confidence, rungs, "VERY LOW")


def risk_level(celebrity: Column, is_fake: Column, confidence: Column) -> Column:
    return (
        F.when(celebrity & is_fake, "CRITICAL")
        .when(celebrity, "HIGH")
        .when(is_fake & (confidence >= 0.7), "HIGH")
        .when(is_fake, "MEDIUM")
        .otherwise("LOW")
    )


def is_private_ip(ip: Column) -> Column:
    return ip.rlike("^(?:" + "|".join(p.replace(".", "\\.") for p in PRIVATE_PREFIXES) + ")")


def client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    """First forwarded entry, else the real-IP header, else the peer, else loopback."""
    present = lambda c: F.nullif(c, F.lit(""))
    first = F.trim(F.get(F.split(present(forwarded), ","), F.lit(0)))
    return F.coalesce(first, present(real_ip), present(remote), F.lit("127.0.0.1"))


def to_basis_points(percent: Column) -> Column:
    """0-100 to 0-10000, truncated toward zero and clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(10000), (percent * 100).cast("int")))


def from_basis_points(points: Column) -> Column:
    return points / 100.0


def to_micro_degrees(degrees: Column) -> Column:
    return (degrees * 1000000).cast("int")


def from_micro_degrees(scaled: Column) -> Column:
    return scaled / 1000000


def registration_error(
    content_hash: Column, confidence: Column, lipsync: Column, fact: Column
) -> Column:
    """Reason a registration is refused, or NULL. Scores are basis points."""
    return (
        F.when(is_zero_hash(content_hash), "invalid content hash")
        .when(confidence > 10000, "confidence exceeds 10000")
        .when(lipsync > 10000, "lipsync score exceeds 10000")
        .when(fact > 10000, "fact-check score exceeds 10000")
    )


def is_zero_hash(value: Column) -> Column:
    return value.isNull() | value.rlike("^(?:0x)?0*$")


def outbox_route(kind: Column) -> Column:
    return (
        F.when(kind.isin(BATCHABLE_KINDS), "batchable")
        .when(kind.isin(KNOWN_KINDS), "individual")
        .otherwise("unknown")
    )


def severity_rank(severity: Column) -> Column:
    rank = None
    for i, name in enumerate(SEVERITIES):
        rank = (rank if rank is not None else F).when(severity == name, i)
    return rank.otherwise(0)


def score_band(score: Column) -> Column:
    bands = ladder(score, [(0.7, "high"), (0.4, "medium")], "low")
    return F.when(score.isNull(), "N/A").otherwise(bands)


def host_of(url: Column) -> Column:
    """Host name by pattern: malformed URLs give NULL instead of failing the job."""
    return F.nullif(
        F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)),
        F.lit(""),
    )


def platform_of(url: Column) -> Column:
    """Platform whose registered domain is the host or a suffix of it; NULL for others."""
    host = host_of(url)
    name = None
    for domain, platform in PLATFORMS.items():
        hit = host.rlike("(^|\\.)" + domain.replace(".", "\\.") + "$")
        name = (name if name is not None else F).when(hit, platform)
    return name


def country_flag(code: Column) -> Column:
    """Regional-indicator pair of a two-letter code; a white flag for anything else."""
    upper = F.upper(code)

    def indicator(position: int) -> Column:
        # indicator symbols follow the alphabet from code point 127462, here as UTF-8 bytes
        letter = F.ascii(F.substring(upper, position, 1))
        return F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(letter - 65 + 166))), "UTF-8")

    real = upper.rlike("^[A-Z]{2}$") & (upper != "XX")
    return F.when(real, F.concat(indicator(1), indicator(2))).otherwise("\U0001f3f3️")


def thumbnail_gate(has_face: Column, quality: Column) -> dict[str, Column]:
    sure = ~has_face | (quality > 0.8)
    return {
        "high_confidence": sure,
        "is_deepfake": F.when(sure, F.lit(False)),
        "confidence": F.when(sure, 0.85).otherwise(0.5),
        "thumbnail_quality": F.round(quality, 3),
    }


def classify_mutation(distance: Column) -> Column:
    return (
        F.when(distance.between(1, 5), "minor_compression")
        .when(distance.between(6, 15), "moderate_edit")
        .when(distance.between(16, 30), "significant_modification")
        .when(distance > 30, "major_transformation")
        .otherwise("unknown_modification")
    )


def quality_mutations(laplacian: Column, border_edges: Column) -> Column:
    """Labels from frame metrics; unknown when none applies."""
    found = F.array_compact(
        F.array(
            F.when(laplacian < 100, "heavy_compression").when(laplacian < 500, "light_compression"),
            F.when(border_edges > 50, "possible_watermark"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("unknown_modification"))).otherwise(found)
