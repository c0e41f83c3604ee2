"""Explicit schemas of the stored tables; nothing is inferred from data."""

FINGERPRINTS = (
    "video_hash string, perceptual_hash string, vec_id bigint, variant int, is_deepfake boolean, "
    "confidence double, lipsync_score double, fact_check_score double, first_seen timestamp_ntz, "
    "last_seen timestamp_ntz, detection_count bigint"
)
LINEAGE = (
    "video_hash string, parent_hash string, generation int, first_seen timestamp_ntz, "
    "source_platform string, is_deepfake boolean, confidence double, origin_country string, "
    "origin_city string, origin_latitude double, origin_longitude double, family int"
)
SIGHTINGS = (
    "event_id bigint, ts timestamp_ntz, item int, video_hash string, ip string, ip_hash string, "
    "country string, city string, latitude double, longitude double, platform string, "
    "confidence double, is_deepfake boolean, seconds bigint"
)
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
OFFLINE_ENTRY = "tx_type string, payload map<string, string>, timestamp double"
