"""Alert candidates, cooldown, acknowledgement, routing and messages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions.decide import SEVERITIES, ladder, severity_rank, to_basis_points
from trailmark.operators.spread import (
    MILESTONE_STEP,
    MILESTONES,
    first_country_events,
    same_ip_reuploads,
)
from trailmark.session import cut_lineage
from trailmark.sources.rules import ALERT_RULES, GLOBAL_RULES

DAY = 86_400
#: Slots of a key's history that are chained together; a longer history is a chain of such runs.
BLOCK_SLOTS = 64
UNBOUNDED = np.iinfo("int64").max
KEYS = ["video_hash", "alert_type"]

CANDIDATE_COLUMNS = [
    "alert_id", "video_hash", "alert_type", "severity", "message", "ts", "seconds", "event_id",
    "ip_hash", "country",
]


def effective_rules(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Thresholds of every item: its own row where there is one, else the global values."""
    own = overrides.select("video_hash", *[F.col(k).alias(f"_{k}") for k in GLOBAL_RULES])
    joined = items.select("video_hash").distinct().join(own, "video_hash", "left")
    return joined.select(
        "video_hash",
        *[F.coalesce(F.col(f"_{k}"), F.lit(v)).alias(k) for k, v in GLOBAL_RULES.items()],
    )


def _alert(
    kind: str, severity: Column, message: Column, source: bool = True, place: bool = True
) -> Column:
    """One alert as a struct; the id comes from the content, so no global counter is needed."""
    key = F.concat_ws("|", "video_hash", F.lit(kind), F.col("event_id").cast("string"))
    values = {
        "alert_id": F.substring(F.sha2(key, 256), 1, 16),
        "video_hash": F.col("video_hash"),
        "alert_type": F.lit(kind),
        "severity": severity,
        "message": message,
        "ts": F.col("ts"),
        "seconds": F.col("seconds"),
        "event_id": F.col("event_id"),
        "ip_hash": F.col("ip_hash") if source else F.lit(""),
        "country": F.col("country") if place else F.lit(""),
    }
    return F.struct(*[c.alias(n) for n, c in values.items()])


def _rows(df: DataFrame, *alerts: Column) -> DataFrame:
    """The non-NULL alerts of every row, one row each."""
    return df.select(F.inline(F.array_compact(F.array(*alerts))))


def first_detection_severity(confidence: Column, policy: str = "ledger") -> Column:
    """Severity of a first detection; confidence is 0-1."""
    if policy == "ledger":
        points = to_basis_points(confidence * 100)
        return ladder(points, [(8000, "CRITICAL"), (6000, "HIGH")], "MEDIUM")
    if policy == "rules":
        return rule_severity("first_detection", confidence * 100)
    if policy == "web":
        return F.when(confidence > 0.9, "CRITICAL").otherwise("HIGH")
    raise ValueError(f"unknown severity policy: {policy}")


def rule_severity(kind: str, value: Column, policy: dict = ALERT_RULES) -> Column:
    """Highest configured rung the value reaches, LOW below all of them."""
    rungs = policy["severity_rules"][kind]
    return ladder(value, [(floor, name) for name, floor in rungs.items()], "LOW")


def first_detection_alerts(sightings: DataFrame, policy: str = "ledger") -> DataFrame:
    """One alert per item at its first detection as fake."""
    rows = sightings.where("is_deepfake")
    if policy == "web":
        rows = rows.where("confidence >= 0.7")
    payload = F.struct("ts", "seconds", "event_id", "ip_hash", "country", "confidence")
    firsts = (
        rows.groupBy("video_hash")
        .agg(F.min_by(payload, F.struct("ts", "event_id")).alias("f"))
        .select("video_hash", "f.*")
    )
    points = to_basis_points(F.col("confidence") * 100)
    message = F.concat(
        F.lit("New deepfake detected with "),
        F.floor(points / 100).cast("string"),
        F.lit("% confidence from "),
        F.col("country"),
    )
    severity = first_detection_severity(F.col("confidence"), policy)
    return _rows(firsts, _alert("FIRST_DETECTION", severity, message))


def reupload_alerts(
    sightings: DataFrame, rules: DataFrame, run_rows: int | None = None, policy: str = "ledger"
) -> DataFrame:
    """Uploads whose number by one source reaches the item's re-upload threshold."""
    rows = same_ip_reuploads(sightings, run_rows, rules)
    hits = rows.where("enabled and upload_count >= reupload_threshold")
    message = F.concat(
        F.lit("Flagged video re-uploaded "),
        F.col("upload_count").cast("string"),
        F.lit(" times from same IP in "),
        F.col("country"),
    )
    severity = (
        F.lit("HIGH") if policy == "ledger" else rule_severity("reupload", F.col("upload_count"))
    )
    return _rows(hits, _alert("REUPLOAD", severity, message))


def _geo_spread(policy: str = "ledger") -> Column:
    """New-country event once the item is in as many countries as its threshold, else NULL."""
    n = F.col("unique_countries")
    message = F.concat(
        F.lit("Deepfake spread from "),
        F.col("previous_country"),
        F.lit(" to "),
        F.col("country"),
        F.lit(" ("),
        n.cast("string"),
        F.lit(" countries total)"),
    )
    critical_from = {"ledger": 10, "listener": 5}
    severity = (
        rule_severity("geo_spread", n)
        if policy == "rules"
        else F.when(n >= critical_from[policy], "CRITICAL").otherwise("HIGH")
    )
    due = F.expr(
        "enabled and is_new_country and spread_count > 1 and unique_countries >= country_threshold"
    )
    return F.when(due, _alert("GEO_SPREAD", severity, message, source=False))


def _threshold() -> Column:
    count = F.col("spread_count").cast("string")
    message = F.concat(F.lit("Video detected "), count, F.lit(" times"))
    due = F.expr("enabled and spread_count % detection_threshold = 0")
    return F.when(due, _alert("THRESHOLD", F.lit("HIGH"), message, source=False, place=False))


def _viral() -> Column:
    message = F.concat(
        F.lit("Video spread to "),
        F.col("spread_count").cast("string"),
        F.lit(" locations across "),
        F.col("unique_countries").cast("string"),
        F.lit(" countries"),
    )
    due = F.expr("enabled and spread_count % spread_threshold = 0")
    return F.when(due, _alert("VIRAL", F.lit("CRITICAL"), message, source=False, place=False))


def _numbered(sightings: DataFrame, rules: DataFrame, run_rows: int) -> DataFrame:
    return first_country_events(sightings, run_rows, rules)


def geo_spread_alerts(
    sightings: DataFrame, rules: DataFrame, run_rows: int | None = None, policy: str = "ledger"
) -> DataFrame:
    return _rows(_numbered(sightings, rules, run_rows), _geo_spread(policy))


def threshold_alerts(
    sightings: DataFrame, rules: DataFrame, run_rows: int | None = None
) -> DataFrame:
    return _rows(_numbered(sightings, rules, run_rows), _threshold())


def viral_alerts(sightings: DataFrame, rules: DataFrame, run_rows: int | None = None) -> DataFrame:
    return _rows(_numbered(sightings, rules, run_rows), _viral())


def all_candidates(
    sightings: DataFrame, rules: DataFrame, run_rows: int | None = None
) -> DataFrame:
    """Candidates of every type; the three that count events share one numbering of them.

    The sightings are written once: the numbering, the re-uploads and the first detections read them.
    """
    sightings = cut_lineage(sightings)
    enabled = rules.where("enabled").select("video_hash")
    first = first_detection_alerts(sightings).join(enabled, "video_hash", "left_semi")
    counted = _rows(
        _numbered(sightings, rules, run_rows), _geo_spread(), _threshold(), _viral()
    )
    again = reupload_alerts(sightings, rules, run_rows)
    return first.select(*CANDIDATE_COLUMNS).unionByName(counted).unionByName(again)


def alert_cooldown(
    candidates: DataFrame,
    cooldowns: dict[str, int] | None = None,
    default_seconds: int = 300,
    tie: str = "event_id",
    group_rows: int = 100_000,
) -> DataFrame:
    """Keeps a candidate iff the last kept one of its (item, type) is at least the cooldown ago.

    The choice is sequential, yet no task walks a whole history:
    candidates of one second are folded to the first of them; one with no neighbour closer than
    the longest cooldown is kept at once; the rest is walked per time slot, where a key has at
    most one row per second. A slot depends on earlier ones only through its first kept second,
    so each slot first lists, for every second that may come first, where it would end. Runs of
    ``BLOCK_SLOTS`` slots are folded to one such list each; chaining the lists of the runs, and then
    those of the slots within each run, fixes the first kept second of every slot.

    Keys are walked together, about ``group_rows`` rows to a call, however many keys there are.
    """
    per_type = cooldowns or {}
    longest = max([default_seconds, *per_type.values()])
    cooldown = F.lit(default_seconds)
    for kind, seconds in per_type.items():
        cooldown = F.when(F.col("alert_type") == kind, seconds).otherwise(cooldown)
    # candidates are few next to sightings; written once, they are read by every step below
    rows = cut_lineage(candidates.withColumn("_cooldown", cooldown.cast("bigint")))
    free = rows.where("_cooldown <= 0").drop("_cooldown")
    if longest <= 0:
        return free
    payload = F.struct(*[c for c in candidates.columns if c not in KEYS and c != "seconds"])
    heads = (
        rows.where("_cooldown > 0")
        .groupBy(*KEYS, "_cooldown", "seconds")
        .agg(F.min_by(payload, F.col(tie)).alias("_row"))
    )

    slot_seconds = max(DAY, 8 * longest)
    slot, into = F.floor(F.col("seconds") / slot_seconds), F.col("seconds") % slot_seconds
    reach = longest - 1
    shared = F.array_compact(
        F.array(
            slot,
            F.when(into >= slot_seconds - reach, slot + 1),
            F.when(into < reach, slot - 1),
        )
    )
    near = Window.partitionBy(*KEYS, "_slot").orderBy("seconds").rangeBetween(-reach, reach)
    marked = (
        heads.withColumn("_slot", F.explode(shared))
        .withColumn("_near", F.count(F.lit(1)).over(near))
        .where(F.col("_slot") == slot)
    )
    alone = marked.where("_near = 1").drop("_near", "_slot", "_cooldown")
    # as many buckets of keys as keep a call near the wanted size even if all rows share one slot
    buckets = max(1, math.ceil(rows.count() / group_rows))
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).alias("_bucket")
    crowded = marked.where("_near > 1").select(*KEYS, "seconds", "_cooldown", "_slot", bucket)

    key_schema = "video_hash string, alert_type string, _slot bigint, _bucket bigint"
    options = crowded.groupBy("_bucket", "_slot").applyInPandas(
        lambda group: slot_ends(group, slot_seconds),
        f"{key_schema}, _cooldown bigint, entry bigint, exit bigint",
    )
    # read twice: to fold the runs of slots, and to chain the slots within them
    options = cut_lineage(options.withColumn("_block", F.floor(F.col("_slot") / BLOCK_SLOTS)))
    block_key = "video_hash string, alert_type string, _block bigint, _bucket bigint"
    folded = options.groupBy("_bucket", "_block").applyInPandas(
        fold_block, f"{block_key}, upto bigint, after bigint"
    )
    opened = folded.groupBy("_bucket").applyInPandas(chain_blocks, f"{block_key}, allowed bigint")
    firsts = (
        options.join(opened, [*KEYS, "_block", "_bucket"])
        .groupBy("_bucket", "_block")
        .applyInPandas(chain_slots, f"{key_schema}, entry bigint")
    )
    kept = (
        crowded.join(firsts, [*KEYS, "_slot", "_bucket"])
        .groupBy("_bucket", "_slot")
        .applyInPandas(
            lambda group: kept_seconds(group, slot_seconds),
            "video_hash string, alert_type string, seconds bigint",
        )
    )
    chosen = heads.drop("_cooldown").join(kept, [*KEYS, "seconds"])
    both = chosen.unionByName(alone).select(*KEYS, "seconds", "_row.*")
    return both.select(*candidates.columns).unionByName(free)


def _ordered(group: pd.DataFrame, column: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by key and time, and the number of the key of every row."""
    numbers = group.groupby(KEYS, sort=False).ngroup().to_numpy()
    order = np.lexsort((group[column].to_numpy(), numbers))
    return group.iloc[order], numbers[order]


def _next_allowed(key: np.ndarray, into: np.ndarray, gap: np.ndarray, width: int) -> np.ndarray:
    """Row of the same key that may be kept next; the number of rows where there is none."""
    line = key * width + into
    after = np.searchsorted(line, line + gap, side="left")
    n = len(key)
    other = after < n
    other[other] = key[after[other]] != key[other]
    return np.where(other, n, after)


def slot_ends(group: pd.DataFrame, slot_seconds: int) -> pd.DataFrame:
    """Per key of a slot: each second that may be kept first, and the last one kept then."""
    rows, key = _ordered(group, "seconds")
    start = int(rows["_slot"].iloc[0]) * slot_seconds
    into = rows["seconds"].to_numpy() - start
    gap = rows["_cooldown"].to_numpy()
    n = len(rows)
    jump = _next_allowed(key, into, gap, slot_seconds + int(gap.max()) + 1)
    last = np.arange(n)
    while (jump < n).any():
        inside = jump < n
        last[inside] = last[jump[inside]]
        jump[inside] = jump[jump[inside]]
    # an earlier kept second blocks less than one cooldown of the slot
    early = into < gap
    opens = np.ones(n, dtype=bool)
    opens[1:] = (key[1:] != key[:-1]) | early[:-1]
    wanted = early | opens
    out = rows.loc[wanted, [*KEYS, "_slot", "_bucket", "_cooldown"]]
    seconds = rows["seconds"].to_numpy()
    return out.assign(entry=seconds[wanted], exit=seconds[last[wanted]])


def _first_fit(key: np.ndarray, entry: np.ndarray, of: np.ndarray, allowed: np.ndarray):
    """For each (key, first allowed second): the place of its first entry then, and whether there is one.

    Rows are in order of (key, entry).
    """
    base, width = int(entry.min()), int(entry.max() - entry.min()) + 2
    wait = np.clip(allowed - base, 0, width - 1)
    at = np.searchsorted(key * width + (entry - base), of * width + wait, side="left")
    fits = at < len(key)
    fits[fits] = key[at[fits]] == of[fits]
    return at, fits


def fold_block(group: pd.DataFrame) -> pd.DataFrame:
    """Per key of a run of slots: up to which first allowed second it would end where.

    What comes before a run matters only within the first slot that has rows: it decides which of that
    slot's entries is taken, or (the last line, without bound) that none is. ``after`` is the
    first second allowed after the run, -1 if nothing is kept in it.
    """
    group = group.assign(_k=group.groupby(KEYS, sort=False).ngroup())
    group = group.sort_values(["_slot", "_k", "entry"])
    n = int(group["_k"].max()) + 1
    gap = np.zeros(n, dtype="int64")
    gap[group["_k"].to_numpy()] = group["_cooldown"].to_numpy()
    opening = group.groupby("_k")["_slot"].min().reindex(range(n)).to_numpy()
    lead = group[group["_slot"].to_numpy() == opening[group["_k"].to_numpy()]]
    # one chain for every entry of the opening slot, and one that takes none of them
    of = np.concatenate([lead["_k"].to_numpy(), np.arange(n)])
    upto = np.concatenate([lead["entry"].to_numpy(), np.full(n, UNBOUNDED)])
    allowed = np.concatenate([lead["exit"].to_numpy() + gap[lead["_k"].to_numpy()], np.zeros(n, "int64")])
    kept = np.arange(len(of)) < len(lead)
    for slot, options in group.groupby("_slot"):
        later = np.flatnonzero(opening[of] < slot)
        if not len(later):
            continue
        at, fits = _first_fit(options["_k"].to_numpy(), options["entry"].to_numpy(), of[later], allowed[later])
        chains = later[fits]
        allowed[chains] = options["exit"].to_numpy()[at[fits]] + gap[of[chains]]
        kept[chains] = True
    keys = group.drop_duplicates("_k").set_index("_k").loc[of, [*KEYS, "_block", "_bucket"]]
    return keys.assign(upto=upto, after=np.where(kept, allowed, -1)).reset_index(drop=True)


def chain_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Per key: the first second allowed at the start of every run of slots."""
    group = group.assign(_k=group.groupby(KEYS, sort=False).ngroup())
    allowed = np.zeros(int(group["_k"].max()) + 1, dtype="int64")
    found = []
    for _, lines in group.sort_values(["_block", "_k", "upto"]).groupby("_block"):
        key = lines["_k"].to_numpy()
        present, first, size = np.unique(key, return_index=True, return_counts=True)
        found.append(lines.iloc[first].assign(allowed=allowed[present]))
        # the last line of a key has no bound and fits always
        bounds = np.where(lines["upto"].to_numpy() == UNBOUNDED, np.iinfo("int64").max, lines["upto"].to_numpy())
        short = bounds < np.repeat(allowed[present], size)
        line = first + np.add.reduceat(short.astype(int), first)
        after = lines["after"].to_numpy()[line]
        allowed[present] = np.where(after < 0, allowed[present], after)
    return pd.concat(found)[[*KEYS, "_block", "_bucket", "allowed"]]


def chain_slots(group: pd.DataFrame) -> pd.DataFrame:
    """Per key: the first kept second of every slot of a run, slot after slot for all keys at once."""
    group = group.assign(_k=group.groupby(KEYS, sort=False).ngroup())
    gap = np.zeros(int(group["_k"].max()) + 1, dtype="int64")
    gap[group["_k"].to_numpy()] = group["_cooldown"].to_numpy()
    allowed = np.zeros(len(gap), dtype="int64")
    allowed[group["_k"].to_numpy()] = group["allowed"].to_numpy()
    found = []
    for _, options in group.sort_values(["_slot", "_k", "entry"]).groupby("_slot"):
        key, entry = options["_k"].to_numpy(), options["entry"].to_numpy()
        present = np.unique(key)
        at, fits = _first_fit(key, entry, present, allowed[present])
        chosen = options.iloc[at[fits]]
        allowed[present[fits]] = chosen["exit"].to_numpy() + gap[present[fits]]
        found.append(chosen)
    return pd.concat(found)[[*KEYS, "_slot", "_bucket", "entry"]]


def kept_seconds(group: pd.DataFrame, slot_seconds: int) -> pd.DataFrame:
    """Per key of a slot: the kept seconds, walked from the first one."""
    rows, key = _ordered(group, "seconds")
    seconds = rows["seconds"].to_numpy()
    gap = rows["_cooldown"].to_numpy()
    into = seconds - int(rows["_slot"].iloc[0]) * slot_seconds
    after = _next_allowed(key, into, gap, slot_seconds + int(gap.max()) + 1)
    kept = np.zeros(len(rows), dtype=bool)
    at = np.flatnonzero(seconds == rows["entry"].to_numpy())
    while len(at):
        kept[at] = True
        at = after[at]
        at = at[at < len(rows)]
    return rows.loc[kept, KEYS].assign(seconds=seconds[kept])


def create_alerts(
    sightings: DataFrame,
    rules: DataFrame,
    cooldowns: dict[str, int] | None = None,
    default_seconds: int = 300,
    run_rows: int | None = None,
) -> DataFrame:
    """The alert log: every candidate that outlives the cooldown, not yet acknowledged."""
    kept = alert_cooldown(all_candidates(sightings, rules, run_rows), cooldowns, default_seconds)
    return kept.withColumns(
        {
            "acknowledged": F.lit(False),
            "acknowledged_by": F.lit(None).cast("bigint"),
            "acknowledged_at": F.lit(None).cast("timestamp_ntz"),
        }
    )


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Sets the acknowledgement once: the earliest per alert; unknown ids and repeats do nothing."""
    first = acks.groupBy("alert_id").agg(
        F.min(F.struct("acked_at", "acked_by")).alias("_ack")
    )
    joined = alerts.join(first, "alert_id", "left")
    fresh = ~F.col("acknowledged") & F.col("_ack").isNotNull()
    return joined.withColumns(
        {
            "acknowledged_by": F.when(fresh, F.col("_ack.acked_by")).otherwise(
                F.col("acknowledged_by")
            ),
            "acknowledged_at": F.when(fresh, F.col("_ack.acked_at")).otherwise(
                F.col("acknowledged_at")
            ),
            "acknowledged": F.col("acknowledged") | fresh,
        }
    ).drop("_ack")


def auto_acknowledge(alerts: DataFrame, now: Column, policy: dict = ALERT_RULES) -> DataFrame:
    """Marks open alerts of the configured types that are old. ``now`` is epoch seconds."""
    auto = policy["auto_acknowledge"]
    old = now - F.col("seconds") > auto["older_than_hours"] * 3600
    due = ~F.col("acknowledged") & old & F.col("alert_type").isin(auto["types"])
    return alerts.withColumn("auto_acknowledged", due)


def escalate(alerts: DataFrame, now: Column, policy: dict = ALERT_RULES) -> DataFrame:
    """Names the channel of alerts still open after the escalation time."""
    late = policy["escalation"]
    overdue = now - F.col("seconds") > late["escalate_after_minutes"] * 60
    channel = F.when(~F.col("acknowledged") & overdue, F.lit(late["escalation_channel"]))
    return alerts.withColumn("escalate_to", channel)


def notify_filter(alerts: DataFrame, min_severity: str = "MEDIUM") -> DataFrame:
    return alerts.where(severity_rank(F.col("severity")) >= SEVERITIES.index(min_severity))


def _routing(spark: SparkSession, policy: dict) -> DataFrame:
    routes = [
        (severity, channel)
        for severity, channels in policy["routing"].items()
        for channel in channels
    ]
    return spark.createDataFrame(routes, "severity string, channel string")


def route_channels(alerts: DataFrame, policy: dict = ALERT_RULES) -> DataFrame:
    """One row per delivery. The broadcast side is the routing section of the rules."""
    return alerts.join(F.broadcast(_routing(alerts.sparkSession, policy)), "severity")


def deliver_plan(
    alerts: DataFrame, min_severity: str = "MEDIUM", policy: dict = ALERT_RULES
) -> DataFrame:
    """Deliveries of the alerts that pass the severity filter, always with a console line."""
    passed = notify_filter(alerts, min_severity)
    console = passed.withColumn("channel", F.lit("console"))
    routed = route_channels(passed, policy).where("channel <> 'console'")
    return console.unionByName(routed.select(*console.columns)).withColumn(
        "delivery_id", F.concat_ws("/", "alert_id", "channel")
    )


def watchlist_boost(alerts: DataFrame, groups: DataFrame) -> DataFrame:
    """Severity raised to that of the monitored groups the country is in."""
    boost = groups.groupBy("country").agg(
        F.max(severity_rank(F.col("severity_boost"))).alias("_boost")
    )
    rank = F.greatest(severity_rank(F.col("severity")), F.coalesce("_boost", F.lit(0)))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return (
        alerts.join(boost, "country", "left")
        .withColumn("boosted_severity", F.element_at(names, rank + 1))
        .drop("_boost")
    )


def listener_messages(
    sightings: DataFrame, run_rows: int | None = None
) -> DataFrame:
    """Notification text per ledger event: (event_id, kind, severity, message)."""
    tag = F.concat(F.lit("Hash: "), F.substring("video_hash", 1, 16), F.lit("…\n"))
    source = F.concat(F.lit("IP: "), F.substring("ip_hash", 1, 16), F.lit("…"))
    text = lambda c: F.col(c).cast("string")
    tenths = F.floor((to_basis_points(F.col("confidence") * 100) + 5) / 10)
    percent = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )

    def told(due, kind: str, severity, *parts: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        row = F.struct(F.lit(kind).alias("kind"), level.alias("severity"), F.concat(*parts).alias("message"))
        return F.when(due, row)

    first_fake = told(
        F.expr("spread_count = 1 and is_deepfake"), "DEEPFAKE_DETECTED", "HIGH",
        F.lit("\U0001f6a8 NEW DEEPFAKE DETECTED\n"), tag, F.lit("Confidence: "), percent,
        F.lit("%\nLocation: "), F.col("city"), F.lit(", "), F.col("country"),
    )
    again = told(
        F.col("spread_count") >= 3, "VIDEO_REDETECTED", "MEDIUM",
        F.lit("\U0001f501 VIDEO RE-DETECTED (#"), text("spread_count"), F.lit(")\n"), tag,
        F.lit("New "), source,
    )
    same_ip = told(
        F.lit(True), "SAME_IP_REUPLOAD", "HIGH",
        F.lit("⚠️ SAME IP RE-UPLOAD\n"), tag, source, F.lit("\nUpload #"),
        text("upload_count"), F.lit(" | Time since first: "), text("seconds_since_first"),
        F.lit("s"),
    )
    country = told(
        F.expr("is_new_country and spread_count > 1"), "GEO_SPREAD",
        F.when(F.col("unique_countries") >= 5, "CRITICAL").otherwise("HIGH"),
        F.lit("\U0001f30d GEO SPREAD DETECTED\n"), tag, F.lit("From: "),
        F.col("previous_country"), F.lit(" → "), F.col("country"),
        F.lit("\nUnique countries: "), text("unique_countries"),
    )
    n = F.col("spread_count")
    viral = told(
        n.isin(MILESTONES) | (n % MILESTONE_STEP == 0), "VIRAL_SPREAD", "CRITICAL",
        F.lit("\U0001f525 VIRAL SPREAD WARNING\n"), tag, F.lit("Spread events: "),
        text("spread_count"), F.lit("\nCountries: "), text("unique_countries"),
    )

    def rows(df: DataFrame, *messages: Column) -> DataFrame:
        return df.select("event_id", F.inline(F.array_compact(F.array(*messages))))

    # all that the running numbers tell, in one pass over them
    numbered = rows(first_country_events(sightings, run_rows), first_fake, again, country, viral)
    return numbered.unionByName(rows(same_ip_reuploads(sightings, run_rows), same_ip))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("video_hash").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged_alerts"),
    )
