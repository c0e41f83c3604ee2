"""Alert and geography rules: default values, and rules read from a file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# fixed values: thresholds that hold where an item has none of its own
GLOBAL_RULES = {
    "detection_threshold": 100,
    "spread_threshold": 50,
    "country_threshold": 5,
    "reupload_threshold": 3,
    "enabled": True,
}

# fixed values: alert policy
ALERT_RULES = {
    "cooldown": {
        "default_seconds": 300,
        "per_type": {
            "FIRST_DETECTION": 0,
            "REUPLOAD": 180,
            "GEO_SPREAD": 300,
            "THRESHOLD": 600,
            "VIRAL": 900,
        },
    },
    "severity_rules": {
        "first_detection": {"CRITICAL": 95.0, "HIGH": 80.0, "MEDIUM": 60.0},
        "reupload": {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 3},
        "geo_spread": {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 3},
    },
    "routing": {
        "CRITICAL": ["telegram", "discord", "email"],
        "HIGH": ["telegram", "discord"],
        "MEDIUM": ["telegram"],
        "LOW": ["console"],
    },
    "auto_acknowledge": {"older_than_hours": 48, "types": ["THRESHOLD"]},
    "escalation": {"escalate_after_minutes": 60, "escalation_channel": "email"},
}

# fixed values: spread rules
GEO_RULES = {
    "city_threshold": 5,
    "velocity_window_seconds": 3600,
    "rapid_spread_threshold": 10,
    "rapid_window_seconds": 1800,
    "rapid_reupload_threshold": 3,
    "cluster_radius_km": 50.0,
}


def read_rule_file(spark: SparkSession, path: str) -> dict:
    """A rule file, in any file system Spark reads, as a dictionary: JSON, or YAML where a YAML reader is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML rules needs the yaml package; use JSON") from missing
    return yaml.safe_load(text)


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Numeric thresholds as rows (rule, threshold), from a file's ``global_thresholds`` if given."""
    values = dict(GLOBAL_RULES)
    if path:
        values |= read_rule_file(spark, path).get("global_thresholds", {})
    rows = [(k, int(v)) for k, v in values.items() if not isinstance(v, bool)]
    return spark.createDataFrame(rows, "rule string, threshold bigint")


def _ladder(rungs: dict) -> dict:
    """{"critical_threshold": 95, ..., "low_count": 1} as {"CRITICAL": 95, ...}; LOW is below all rungs."""
    named = {k.split("_")[0].upper(): v for k, v in rungs.items()}
    order = [s for s in ("CRITICAL", "HIGH", "MEDIUM") if s in named]
    return {s: named[s] for s in order}


def load_alert_rules(spark: SparkSession, path: str) -> dict:
    """Cooldowns, severity ladders, routes, acknowledgement and escalation of a rule file.

    Sections and keys that the file leaves out keep their defaults. The alert operators take the
    result as ``policy``.
    """
    given = read_rule_file(spark, path)
    out = {section: dict(values) for section, values in ALERT_RULES.items()}
    for section in ("routing", "auto_acknowledge", "escalation"):
        out[section] |= given.get(section, {})
    cooldown = given.get("cooldown", {})
    out["cooldown"] = {
        "default_seconds": cooldown.get("default_seconds", out["cooldown"]["default_seconds"]),
        "per_type": out["cooldown"]["per_type"] | cooldown.get("per_type", {}),
    }
    out["severity_rules"] |= {k: _ladder(v) for k, v in given.get("severity_rules", {}).items()}
    return out


def load_geo_rules(spark: SparkSession, path: str) -> dict:
    """The spread thresholds of a geography rule file, and its watched regions, over the defaults.

    Keys are the arguments of the spread operators; ``watchlist`` lists (country, severity_boost).
    """
    given = read_rule_file(spark, path)
    known = {}
    for section in ("spread_detection", "reupload_detection", "coordinates"):
        known |= {k: v for k, v in given.get(section, {}).items() if k in GEO_RULES}
    watch = given.get("watchlist", {})
    regions = watch.get("regions", []) if watch.get("enabled") else []
    pairs = [(country, r["severity_boost"]) for r in regions for country in r["countries"]]
    return GEO_RULES | known | {"watchlist": pairs}
