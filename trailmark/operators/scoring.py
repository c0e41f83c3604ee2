"""Frame-pair features and score fusion over tables of clips, replies and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import arrays, kernels
from trailmark.functions.decide import clamp

# fixed values: share of the reply score and of the local score
LOCAL_WEIGHTS = {"celebrity": 0.1, "handcrafted": 0.2, "cnn": 0.7}
HISTOGRAM_BINS = 256


def sampled_frames(frames: DataFrame, k: int) -> DataFrame:
    """Frames at k evenly spread positions of each clip."""
    lengths = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    picks = lengths.select(
        "video_id",
        F.posexplode(F.array_distinct(arrays.sample_indices(F.col("n"), k))).alias(
            "sample_no", "frame_idx"
        ),
    )
    return frames.join(picks, ["video_id", "frame_idx"])


def frame_pair_join(frames: DataFrame, num_pairs: int = 10) -> DataFrame:
    """Frame i with frame i + 1 for evenly spread i; both sides share one shuffle key."""
    lengths = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    starts = lengths.select(
        "video_id",
        F.explode(
            F.array_distinct(arrays.sample_indices(F.col("n") - 1, num_pairs))
        ).alias("frame_idx"),
    )
    first = frames.join(starts, ["video_id", "frame_idx"])
    second = frames.select(
        "video_id",
        (F.col("frame_idx") - 1).alias("frame_idx"),
        F.col("pixels").alias("next_pixels"),
    )
    return first.join(second, ["video_id", "frame_idx"])


def pair_features(pairs: DataFrame) -> DataFrame:
    """Correlation, structural similarity, lip-sync, pixel difference and mismatch per pair."""
    a, b = F.col("pixels"), F.col("next_pixels")
    m = F.col("_m")
    return (
        pairs.withColumn("_m", arrays.moments(a, b))
        .withColumns(
            {
                "correlation": arrays.correlation_score(m),
                "ssim": arrays.ssim_score(m),
                "lip_sync_score": arrays.lip_sync_score(m),
                "pixel_difference": arrays.pixel_difference(a, b),
            }
        )
        .withColumn("mismatch_score", arrays.mismatch_score(m, F.col("pixel_difference")))
        .drop("_m")
    )


def pair_histogram_similarity(pairs: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Adds the correlation of the two grey histograms of each pair, mapped to [0, 1].

    Row by row, without a shuffle. Empty bins count; two flat histograms correlate fully.
    """
    found = kernels.histogram_correlation(pairs, bins)
    score = clamp((F.col("_correlation") + 1) / 2)
    return found.withColumn("histogram_similarity", score).drop("_correlation")


def mean_features(features: DataFrame, names: list[str]) -> DataFrame:
    return features.groupBy("video_id").agg(*[F.avg(c).alias(c) for c in names])


def prediction_vote(pairs: DataFrame) -> DataFrame:
    """Mean class probabilities over pairs, the likelier class and its probability."""
    means = pairs.groupBy("video_id").agg(
        F.avg("p_real").alias("lipsync_score"), F.avg("p_fake").alias("_fake")
    )
    fake = F.col("_fake") > F.col("lipsync_score")
    return means.select(
        "video_id",
        "lipsync_score",
        fake.alias("is_deepfake"),
        F.greatest("_fake", "lipsync_score").alias("confidence"),
    )


def frame_rollup(frames: DataFrame) -> DataFrame:
    """Face rate, frames with faces and mean quality (0.5 where no frame has a face) per clip."""
    return frames.groupBy("video_id").agg(
        F.count_if("has_face").alias("frames_with_faces"),
        (F.count_if("has_face") / F.count(F.lit(1))).alias("face_detection_rate"),
        F.coalesce(F.avg(F.when(F.col("has_face"), F.col("quality"))), F.lit(0.5)).alias(
            "avg_quality"
        ),
    )


def risk_frame_summary(frames: DataFrame, high: float = 0.6) -> DataFrame:
    return frames.groupBy("video_id").agg(
        F.avg("risk").alias("avg_risk"), F.count_if(F.col("risk") > high).alias("high_risk_frames")
    )


def handcrafted_verdict(freq: Column, edge: Column) -> dict[str, Column]:
    """Verdict from artifacts alone; low confidence is marked uncertain."""
    fake_probability = clamp(freq * 0.6 + F.abs(edge) * 0.2 + 0.2)
    is_fake = freq > 0.4
    confidence = F.when(is_fake, 0.5 + (freq - 0.4) * 0.5).otherwise(0.4)
    return {
        "is_deepfake": is_fake,
        "confidence": confidence,
        "lipsync_score": 1.0 - fake_probability,
        "uncertain": confidence < 0.6,
    }


# fixed values: weight of each score of the edge node, in percent scores
EDGE_WEIGHTS = {
    "optical_flow": 0.25,
    "color_histogram": 0.15,
    "edge_detection": 0.20,
    "frequency_analysis": 0.25,
    "noise_analysis": 0.15,
}


def edge_node_verdict(scores: Column, threshold: float = 65.0) -> dict[str, Column]:
    """Weighted sum over a map of percent scores."""
    confidence = sum(scores[name] * weight for name, weight in EDGE_WEIGHTS.items())
    return {
        "confidence": confidence,
        "is_deepfake": confidence >= threshold,
        "lipsync_score": F.greatest(F.lit(0.0), 100 - scores["optical_flow"]),
    }


def authenticity_score(artifact: Column, news: Column, celebrity: Column, risk: Column) -> Column:
    score = (
        F.when(news == "CONFIRMED_FAKE", F.least(artifact, F.lit(0.3)))
        .when(news == "CONFIRMED_REAL", F.greatest(artifact, F.lit(0.7)))
        .otherwise(artifact)
    )
    factor = (
        F.when(~celebrity, 1.0).when(risk == "HIGH", 0.6).when(risk == "MEDIUM", 0.75).otherwise(0.85)
    )
    return clamp(score * factor)


def fact_verdict(news: Column, authenticity: Column) -> Column:
    return (
        F.when(news == "CONFIRMED_FAKE", "CONFIRMED_FAKE - Known manipulated media")
        .when(news == "CONFIRMED_REAL", "CONFIRMED_REAL - Verified authentic")
        .when(authenticity >= 0.7, "LIKELY_AUTHENTIC - No manipulation detected")
        .when(authenticity >= 0.4, "UNCERTAIN - Manual review recommended")
        .otherwise("LIKELY_FAKE - Manipulation indicators detected")
    )


def indicator_adjust(confidence: Column, is_fake: Column, indicators: list[Column]) -> Column:
    """Confidence (0-1) raised by many indicators, or by none on a real verdict; cap 0.95."""
    found = sum(i.cast("int") for i in indicators)
    return (
        F.when(found >= 3, F.least(F.lit(0.95), confidence * 1.2))
        .when((found == 0) & ~is_fake, F.least(F.lit(0.95), confidence * 1.1))
        .otherwise(confidence)
    )


def fuse_scores(df: DataFrame, policy: str = "detector") -> DataFrame:
    """Fused verdict. Policy ``detector`` works on whole clips, ``frames`` on captured frames."""
    if policy == "detector":
        return _fuse_detector(df)
    if policy == "frames":
        return _fuse_frames(df)
    raise ValueError(f"unknown fusion policy: {policy}")


def _fuse_detector(df: DataFrame) -> DataFrame:
    """Needs local_fake, local_confidence, lipsync_score, method, uncertain; and, NULL when no
    fact check ran, fact_check_score, celebrity_detected, risk, red_flags, news_verdict.
    """
    checked = F.col("fact_check_score").isNotNull()
    fact, local = F.col("fact_check_score"), F.col("lipsync_score")
    celebrity = F.coalesce("celebrity_detected", F.lit(False))
    news = F.coalesce("news_verdict", F.lit("UNKNOWN"))
    flags = F.size(F.coalesce("red_flags", F.array().cast("array<string>")))
    weak_local = F.col("uncertain") | (F.col("method") == "handcrafted")
    weight = (
        F.when(celebrity, LOCAL_WEIGHTS["celebrity"])
        .when(weak_local, LOCAL_WEIGHTS["handcrafted"])
        .otherwise(LOCAL_WEIGHTS["cnn"])
    )
    mixed = (1 - local) * weight + (1 - fact) * (1 - weight)
    penalty = F.when(celebrity & (flags > 0), F.least(F.lit(0.25), flags * 0.08)).otherwise(0.0)
    said_fake, said_real = news == "CONFIRMED_FAKE", news == "CONFIRMED_REAL"
    risky = celebrity & (F.col("risk") == "HIGH") & (fact < 0.60)
    trusted = (fact > 0.8) & (flags == 0)
    base_fake, base = F.col("_p") > 0.5, F.abs(F.col("_p") - 0.5) * 2 + 0.5
    agrees = F.col("local_fake") == (fact < 0.5)

    scored = df.withColumn("_p", F.least(F.lit(1.0), mixed + penalty)).withColumn(
        "_p", F.when(checked, F.when(celebrity & (flags > 0), F.col("_p")).otherwise(mixed))
    )
    celebrity_fake = (
        F.when(said_fake, True)
        .when(said_real, False)
        .when(risky, True)
        .when(fact < 0.5, True)
        .when(trusted, False)
        .otherwise(base_fake)
    )
    celebrity_confidence = (
        F.when(said_fake | said_real, F.greatest(base, F.lit(0.95)))
        .when(risky, F.greatest(base, F.lit(0.75)))
        .when(fact < 0.5, base)
        .when(trusted, fact)
        .otherwise(base)
    )
    fake = F.when(celebrity, celebrity_fake).otherwise(base_fake)
    confidence = F.when(celebrity, celebrity_confidence).otherwise(base)
    review = (
        F.when(celebrity & (said_fake | said_real), F.lit(False))
        .when(risky, F.lit(True))
        .otherwise(F.col("uncertain"))
    )
    return scored.withColumns(
        {
            "fused_fake": F.when(~checked, F.col("local_fake"))
            .when(said_fake, True)
            .when(said_real, False)
            .otherwise(fake),
            "fused_confidence": F.when(~checked, F.col("local_confidence"))
            .when(said_fake | said_real, F.greatest(confidence, F.lit(0.9)))
            .otherwise(confidence),
            "agreement": F.when(checked, F.when(agrees, "agree").otherwise("disagree")),
            "requires_review": F.when(~checked, F.col("uncertain")).otherwise(review | ~agrees),
        }
    ).drop("_p")


def _fuse_frames(df: DataFrame) -> DataFrame:
    """Needs avg_quality, face_detection_rate, reply_present; and, NULL when no reply came, reply_fake,
    reply_authenticity, reply_confidence, personality_detected, personality_category.

    A reply that came without a verdict (reply_fake NULL) leaves the score to the heuristic,
    but the method named is still that of the reply.
    """
    quality = F.col("avg_quality")
    answered = F.col("reply_fake").isNotNull()
    person = F.coalesce("personality_detected", F.lit(False))
    local = F.when(quality > 0.6, 0.3).when(quality < 0.4, 0.6).otherwise(0.45)
    weight = (
        F.when(person & F.col("personality_category").isin("POLITICIAN", "BUSINESS"), 0.90)
        .when(person, 0.85)
        .otherwise(0.70)
    )
    reply = F.when(F.col("reply_fake"), 1.0).otherwise(1 - F.col("reply_authenticity"))
    mixed = reply * weight + local * (1 - weight)
    guess = (quality < 0.4) & (F.col("face_detection_rate") > 0.3)
    guess_confidence = F.when(guess, 0.6 + 0.3 * (1 - quality)).otherwise(0.7 + 0.25 * quality)
    fused = df.withColumns(
        {
            "fused_fake": F.when(answered, mixed > 0.5).otherwise(guess),
            "_c": F.when(
                answered, F.greatest("reply_confidence", F.abs(mixed - 0.5) * 2 + 0.5)
            ).otherwise(guess_confidence),
        }
    )
    fake, c = F.col("fused_fake"), F.col("_c")
    return fused.withColumns(
        {
            "fused_confidence": F.round(c, 3),
            "fused_authenticity": F.round(F.when(fake, 1 - c).otherwise(c), 3),
            "risk_level": F.when(fake, "high").when(c < 0.8, "medium").otherwise("low"),
            "analysis_method": F.when(F.col("reply_present"), "personality_first").otherwise("heuristic"),
        }
    ).drop("_c")


def personality_branch(df: DataFrame) -> DataFrame:
    """Chooses the known-person or the technical reply. Needs structs ``who``, ``known``, ``technical``."""
    identified = F.col("who.detected") & F.col("who.identity").isNotNull()
    both = lambda f: F.when(identified, F.col(f"known.{f}")).otherwise(F.col(f"technical.{f}"))
    category = F.col("who.category")
    fake = F.col("is_deepfake")
    out = df.withColumns(
        {
            "analysis_method": F.when(identified, "personality_specific").otherwise(
                "technical_artifacts"
            ),
            "is_deepfake": both("is_deepfake"),
            "deepfake_confidence": both("confidence") / 100,
            "authenticity_score": both("authenticity_score") / 10,
            "red_flags": F.when(identified, F.col("known.red_flags")).otherwise(
                F.col("technical.artifacts")
            ),
            "recommendation": F.when(identified, F.col("known.recommendation")).otherwise("VERIFY"),
            "risk_level": F.when(category.isin("POLITICIAN", "BUSINESS"), "HIGH")
            .when(F.col("who.detected"), "MEDIUM")
            .otherwise("LOW"),
        }
    )
    return out.withColumn(
        "final_verdict",
        F.when(fake, "FAKE").when(~fake, "AUTHENTIC").otherwise("UNCERTAIN"),
    )
