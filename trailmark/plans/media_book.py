"""Fingerprint, lookup, lineage and registry queries over media fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import arrays, bits, decide, kernels
from trailmark.functions.sql_names import register_sql_functions
from trailmark.operators import families, lineage, lookup, registry, scoring, stats
from trailmark.plans import derived
from trailmark.plans.book import ORACLE, query, rounded
from trailmark.plans.oracle_views import register
from trailmark.session import cut_lineage, scratch_path
from trailmark.sources import band_index, registry_store, tables

# ---- hash, bit and array functions --------------------------------------------------------------


@query("content_hash", """
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents""")
def _(spark, d):
    text = F.col("text")
    kinds = ["sha256", "md5", "sha1"]
    return derived.table(spark, d, "documents").select(
        "doc_id", *[bits.digest(text, k).alias(k) for k in kinds]
    )


@query("ip_hash", """
SELECT event_id, ip_hash, substr(ip_hash, 1, 16) AS short_ip_hash,
       sha256('pepper' || ip) AS salted FROM sightings""")
def _(spark, d):
    ip = F.col("ip")
    return derived.sightings(spark, d).select(
        "event_id",
        bits.ip_hash(ip, "").alias("ip_hash"),
        bits.ip_hash(ip, "", 16).alias("short_ip_hash"),
        bits.ip_hash(ip, "pepper").alias("salted"),
    )


register("dct", """
SELECT video_id, frame_idx, u, v, sum(x * bu * bv) AS c
FROM (SELECT video_id, frame_idx, i // 8 AS py, i % 8 AS px, x FROM frame_pixels) p
JOIN (SELECT u, y, cos(pi() * (2 * y + 1) * u / 16) * sqrt(CASE WHEN u = 0 THEN 1 ELSE 2 END / 8) AS bu
      FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS y)) a ON a.y = p.py
JOIN (SELECT v, y, cos(pi() * (2 * y + 1) * v / 16) * sqrt(CASE WHEN v = 0 THEN 1 ELSE 2 END / 8) AS bv
      FROM (SELECT unnest(range(8)) AS v), (SELECT unnest(range(8)) AS y)) b ON b.y = p.px
GROUP BY ALL""")


@query("dct_lowfreq", """
SELECT video_id, frame_idx, (u * 8 + v)::INT AS coeff_no, round(c, 4) + 0 AS coeff FROM dct""")
def _(spark, d):
    out = kernels.dct_lowfreq(derived.frames(spark, d), 8, 8)
    cells = out.select("video_id", "frame_idx", F.posexplode("coeffs").alias("coeff_no", "c"))
    return cells.withColumn("coeff", F.round("c", 4) + 0.0).drop("c")


@query("median_bits", "SELECT vec_id, bits FROM base_bits")
def _(spark, d):
    return derived.base_bits(spark, d).select("vec_id", "bits")


@query("bits_to_hex", """
SELECT vec_id, substr(perceptual_hash, 1, 16) AS hash FROM media_fingerprints WHERE variant = 3""")
def _(spark, d):
    # variant 3 leaves the first frame as it is, which is the base bit string
    return derived.base_bits(spark, d).select(
        "vec_id", bits.bits_to_hex(F.col("bits")).alias("hash")
    )


@query("dhash", """
SELECT a.video_id, a.frame_idx, string_agg(CASE WHEN b.x > a.x THEN '1' ELSE '0' END, '' ORDER BY a.i) AS bits
FROM frame_pixels a JOIN frame_pixels b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx
 AND b.i = a.i + 1 WHERE a.i % 8 <> 7 GROUP BY ALL""")
def _(spark, d):
    return derived.frames(spark, d).select(
        "video_id", "frame_idx", bits.dhash_bits(F.col("pixels"), 8).alias("bits")
    )


register("sampled", """
SELECT f.* FROM frames f
JOIN (SELECT video_id, unnest(CASE WHEN count(*) < 5 THEN range(count(*))
        ELSE list_transform(range(5), lambda i: i * (count(*) - 1) // 4) END) AS idx
      FROM frames GROUP BY video_id) s ON s.video_id = f.video_id AND s.idx = f.frame_idx""")


@query("multi_part_hash", """
SELECT video_id, count(*) AS parts, sha256(string_agg(part, '' ORDER BY frame_idx)) AS content_hash
FROM (SELECT video_id, frame_idx, array_to_string(list_transform(pixels,
        lambda x: floor(x)::INT::VARCHAR), ',') AS part FROM sampled) GROUP BY video_id""")
def _(spark, d):
    # five sampled frames per clip at most, so the gathered list is short by construction
    levels = F.transform("pixels", lambda x: F.floor(x).cast("string"))
    parts = scoring.sampled_frames(derived.frames(spark, d), bits.FRAMES).select(
        "video_id", "frame_idx", F.array_join(levels, ",").alias("part")
    )
    return bits.multi_part_hash(parts, ["video_id"], "frame_idx", "part")


@query("frame_hash_concat", """
SELECT video_id, count(*) AS frames, string_agg(h, '-' ORDER BY frame_idx) AS perceptual_hash
FROM (SELECT video_id, frame_idx, string_agg(substr('0123456789ABCDEF', 1 + 8 * substr(b, 4*j+1, 1)::INT
        + 4 * substr(b, 4*j+2, 1)::INT + 2 * substr(b, 4*j+3, 1)::INT + substr(b, 4*j+4, 1)::INT, 1),
        '' ORDER BY j) AS h
      FROM (SELECT s.video_id, s.frame_idx,
                   string_agg(CASE WHEN p.x > list_sort(s.pixels)[33] THEN '1' ELSE '0' END, '' ORDER BY p.i) AS b
            FROM sampled s JOIN frame_pixels p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx
            GROUP BY ALL), (SELECT unnest(range(16)) AS j) GROUP BY video_id, frame_idx)
GROUP BY video_id""")
def _(spark, d):
    # five sampled frames per clip at most, so the gathered list is short by construction
    hashed = scoring.sampled_frames(derived.frames(spark, d), bits.FRAMES).select(
        "video_id", "frame_idx", bits.bits_to_hex(bits.median_bits(F.col("pixels"))).alias("h")
    )
    gathered = hashed.groupBy("video_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", "h"))).alias("f")
    )
    return gathered.select(
        "video_id",
        F.size("f").cast("bigint").alias("frames"),
        F.array_join(F.transform("f", lambda x: x["h"]), "-").alias("perceptual_hash"),
    )


@query("replicate_hash", """
SELECT vec_id, substr(perceptual_hash, 1, 16) || repeat('-' || substr(perceptual_hash, 1, 16), 4)
       AS perceptual_hash FROM media_fingerprints WHERE variant = 3""")
def _(spark, d):
    one = bits.bits_to_hex(F.col("bits"))
    return derived.base_bits(spark, d).select(
        "vec_id", F.array_join(F.array_repeat(one, 5), "-").alias("perceptual_hash")
    )


@query("lsh_bands", """
SELECT video_hash, band_index::INT AS band_index,
       coalesce(nullif(ltrim(string_split(perceptual_hash, '-')[band_index + 1], '0'), ''), '0') AS band_value
FROM media_fingerprints, (SELECT unnest(range(5)) AS band_index)""")
def _(spark, d):
    return derived.media_fingerprints(spark, d).select(
        "video_hash",
        F.posexplode(bits.lsh_bands(F.col("perceptual_hash"))).alias("band_index", "band_value"),
    )


register("variant_pairs", """
SELECT a.vec_id, a.variant AS av, b.variant AS bv, a.perceptual_hash AS a, b.perceptual_hash AS b
FROM media_fingerprints a JOIN media_fingerprints b ON b.vec_id = a.vec_id AND b.variant > a.variant""")

register("variant_distance", """
SELECT vec_id, av, bv, a, b, sum(bit_count(xor(('0x' || string_split(a, '-')[i + 1])::UBIGINT,
       ('0x' || string_split(b, '-')[i + 1])::UBIGINT)))::INT AS d
FROM variant_pairs, (SELECT unnest(range(5)) AS i) GROUP BY ALL""")


def _variant_pairs(spark, d):
    m = derived.media_fingerprints(spark, d).select("vec_id", "variant", "perceptual_hash")
    other = m.select("vec_id", F.col("variant").alias("bv"), F.col("perceptual_hash").alias("b"))
    rows = m.withColumnsRenamed({"variant": "av", "perceptual_hash": "a"})
    return rows.join(other, "vec_id").where("bv > av")


@query("hamming", """
SELECT vec_id, av, bv, d AS cache_distance, d AS family_distance, d / 5 AS average_distance,
       d + 64 AS short_distance FROM variant_distance""")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    cut = F.substr(b, F.lit(1), F.lit(67))  # the last frame is missing on one side
    last = bits.hamming(F.substring_index(a, "-", -1), F.substring_index(b, "-", -1))
    return _variant_pairs(spark, d).select(
        "vec_id", "av", "bv",
        bits.hamming(a, b).alias("cache_distance"),
        bits.hamming(a, b, "family").alias("family_distance"),
        bits.hamming(a, b, "average").alias("average_distance"),
        (bits.hamming(a, cut) + last).alias("short_distance"),
    )


@query("char_distance", """
SELECT vec_id, av, bv, sum((substr(a, i + 1, 1) <> substr(b, i + 1, 1))::INT)::INT AS char_distance
FROM variant_pairs, (SELECT unnest(range(84)) AS i) GROUP BY ALL""")
def _(spark, d):
    return _variant_pairs(spark, d).select(
        "vec_id", "av", "bv", bits.char_distance(F.col("a"), F.col("b")).alias("char_distance")
    )


@query("is_similar", """
SELECT vec_id, av, bv, d <= 10 AS cache_similar, d <= 12 AS family_similar, d / 5 <= 10 AS average_similar
FROM variant_distance""")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    return _variant_pairs(spark, d).select(
        "vec_id", "av", "bv",
        bits.is_similar(a, b).alias("cache_similar"),
        bits.is_similar(a, b, "family", bits.FAMILY_THRESHOLD).alias("family_similar"),
        bits.is_similar(a, b, "average").alias("average_similar"),
    )


@query("similarity_score", """
SELECT vec_id, av, bv, round(1 - (d / 5) / 64, 6) AS similarity FROM variant_distance""")
def _(spark, d):
    out = _variant_pairs(spark, d).select(
        "vec_id", "av", "bv", bits.similarity_score(F.col("a"), F.col("b")).alias("similarity")
    )
    return rounded(out, "similarity")


@query("hash_quality", """
SELECT video_hash, length(video_hash)::INT AS content_hash_length,
       length(perceptual_hash)::INT AS perceptual_hash_length,
       len(string_split(perceptual_hash, '-'))::INT AS num_frame_hashes,
       regexp_matches(perceptual_hash, '^[0-9A-F]{16}(-[0-9A-F]{16}){4}$') AS well_formed
FROM media_fingerprints""")
def _(spark, d):
    p = F.col("perceptual_hash")
    return derived.media_fingerprints(spark, d).select(
        "video_hash",
        F.length("video_hash").alias("content_hash_length"),
        F.length(p).alias("perceptual_hash_length"),
        F.size(F.split(p, "-")).alias("num_frame_hashes"),
        p.rlike("^[0-9A-F]{16}(-[0-9A-F]{16}){4}$").alias("well_formed"),
    )


@query("cache_key", """
SELECT page_id, substr(sha256(url || ':' || (page_id % 15)::VARCHAR || ':' || (page_id % 600)::VARCHAR), 1, 32)
       AS frames_key, md5(url) AS thumbnail_key FROM pages""")
def _(spark, d):
    p = F.col("page_id")
    return derived.table(spark, d, "pages").select(
        "page_id",
        bits.cache_key(
            F.col("url"), (p % 15).cast("string"), (p % 600).cast("string")
        ).alias("frames_key"),
        F.md5("url").alias("thumbnail_key"),
    )


@query("pad_hex32", """
SELECT video_hash, substr(rpad(replace('0x' || substr(video_hash, 1, 20), '0x', ''), 64, '0'), 1, 64)
       AS padded FROM media_fingerprints""")
def _(spark, d):
    short = F.concat(F.lit("0x"), F.substring("video_hash", 1, 20))
    return derived.media_fingerprints(spark, d).select(
        "video_hash", bits.pad_hex32(short).alias("padded")
    )


@query("short_hash", """
SELECT video_hash, substr(video_hash, 1, 12) || '...' AS shown FROM media_fingerprints""")
def _(spark, d):
    return derived.media_fingerprints(spark, d).select(
        "video_hash", bits.short_hash(F.col("video_hash"), 12).alias("shown")
    )


# ---- lookup -------------------------------------------------------------------------------------


@query("exact_lookup", """
SELECT m.video_hash, r.is_deepfake, r.confidence, r.first_seen, r.last_seen, r.detection_count
FROM media_fingerprints m JOIN registry r ON r.video_hash = m.video_hash""")
def _(spark, d):
    return lookup.exact_lookup(derived.media_fingerprints(spark, d), derived.registry(spark, d))


@query("exact_phash_lookup", """
SELECT m.perceptual_hash, count(*) AS matches, min(r.video_hash) AS first_match
FROM media_hash m JOIN registry r ON r.perceptual_hash = m.perceptual_hash GROUP BY 1""")
def _(spark, d):
    return lookup.exact_phash_lookup(
        derived.media_fingerprints(spark, d), derived.registry(spark, d)
    )


register("registry_frames", """
SELECT perceptual_hash, i, string_split(perceptual_hash, '-')[i + 1] AS frame
FROM (SELECT DISTINCT perceptual_hash FROM registry), (SELECT unnest(range(5)) AS i)""")


@query("lsh_candidates", """
SELECT q.perceptual_hash, count(DISTINCT r.perceptual_hash) AS candidates,
       count(DISTINCT q.i) AS bands_hit
FROM hash_frames q JOIN registry_frames r ON r.i = q.i AND r.frame = q.frame GROUP BY 1""")
def _(spark, d):
    return lookup.lsh_candidates(
        derived.media_fingerprints(spark, d), derived.registry(spark, d)
    )


@query("candidate_union", """
SELECT DISTINCT q.perceptual_hash FROM hash_frames q
JOIN registry_frames r ON r.i = q.i AND r.frame = q.frame""")
def _(spark, d):
    return lookup.candidate_union(
        derived.media_fingerprints(spark, d), derived.registry(spark, d)
    )


register("registry_pairs", """
SELECT h.* FROM hash_pairs h
WHERE h.distance <= 10 AND h.right_hash IN (SELECT perceptual_hash FROM registry)""")


@query("near_duplicate_join", """
SELECT left_hash AS q_code, right_hash AS r_code, distance,
       (SELECT count(*) FROM media_fingerprints m WHERE m.perceptual_hash = left_hash) AS q_items,
       (SELECT count(*) FROM registry m WHERE m.perceptual_hash = right_hash) AS r_items
FROM registry_pairs""")
def _(spark, d):
    return lookup.near_duplicate_join(
        derived.media_fingerprints(spark, d), derived.registry(spark, d)
    )


@query("tiered_lookup", """
SELECT m.video_hash,
       CASE WHEN e.video_hash IS NOT NULL THEN m.video_hash ELSE coalesce(p.h, n.h) END AS matched_hash,
       CASE WHEN e.video_hash IS NOT NULL THEN 'exact'
            WHEN coalesce(p.h, n.h) IS NOT NULL THEN 'perceptual' ELSE 'miss' END AS cache_hit_type,
       CASE WHEN e.video_hash IS NOT NULL THEN NULL WHEN p.h IS NOT NULL THEN 0 ELSE n.distance END
         AS perceptual_distance
FROM media_fingerprints m
LEFT JOIN registry e ON e.video_hash = m.video_hash
LEFT JOIN (SELECT perceptual_hash, min(video_hash) AS h FROM registry GROUP BY 1) p
  ON p.perceptual_hash = m.perceptual_hash
LEFT JOIN (SELECT g.left_hash, g.distance, r.video_hash AS h,
                  row_number() OVER (PARTITION BY g.left_hash ORDER BY g.distance, r.video_hash) AS rn
           FROM registry_pairs g JOIN registry r ON r.perceptual_hash = g.right_hash) n
  ON n.left_hash = m.perceptual_hash AND n.rn = 1""")
def _(spark, d):
    return lookup.tiered_lookup(
        derived.media_fingerprints(spark, d), derived.registry(spark, d)
    )


@query("indexed_lookup", ORACLE["tiered_lookup"])
def _(spark, d):
    """The same from a stored band index that the registry came into in two appends."""
    path, known = scratch_path(spark, "band-index"), derived.registry(spark, d)
    early = F.pmod(F.xxhash64("video_hash"), F.lit(3)) > 0
    band_index.append(known.where(early), path)
    band_index.append(known.where(~early), path)
    return band_index.lookup(derived.media_fingerprints(spark, d), path)


def _sides(spark, d):
    """Two peers' result tables: overlapping parts of the detections."""
    rows = derived.detections(spark, d).select(
        "video_hash", "variant", "vec_id", "confidence", F.col("first_seen").alias("updated_at")
    )
    mine = rows.where("variant <= 2").withColumn("node", F.lit(1))
    theirs = rows.where("variant >= 1").select(
        "video_hash", "variant", "vec_id",
        (F.col("confidence") / 2).alias("confidence"),
        F.expr("CASE WHEN vec_id % 2 = 0 THEN timestampadd(HOUR, 1, updated_at) ELSE "
               "updated_at END").alias("updated_at"),
        F.lit(2).alias("node"),
    )
    return mine, theirs


register("mine", """
SELECT video_hash, variant, vec_id, confidence, first_seen AS updated_at, 1 AS node
FROM detections WHERE variant <= 2""")
register("theirs", """
SELECT video_hash, variant, vec_id, confidence / 2 AS confidence,
       first_seen + to_hours(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END) AS updated_at, 2 AS node
FROM detections WHERE variant >= 1""")


@query("sync_missing", """
SELECT video_hash, confidence, 'send' AS direction FROM mine WHERE video_hash NOT IN (SELECT video_hash FROM theirs)
UNION ALL
SELECT video_hash, confidence, 'receive' FROM theirs WHERE video_hash NOT IN (SELECT video_hash FROM mine)""")
def _(spark, d):
    mine, theirs = _sides(spark, d)
    return lookup.sync_missing(mine, theirs).select("video_hash", "confidence", "direction")


@query("hash_diff", """
SELECT video_hash, 'local' AS side FROM mine WHERE video_hash NOT IN (SELECT video_hash FROM theirs)
UNION ALL
SELECT video_hash, 'peer' FROM theirs WHERE video_hash NOT IN (SELECT video_hash FROM mine)""")
def _(spark, d):
    return lookup.hash_diff(*_sides(spark, d))


@query("merge_results", """
SELECT video_hash, confidence, updated_at, node FROM (
  SELECT *, row_number() OVER (PARTITION BY video_hash ORDER BY updated_at DESC, node DESC) AS rn
  FROM (SELECT * FROM mine UNION ALL SELECT * FROM theirs)) WHERE rn = 1""")
def _(spark, d):
    return lookup.merge_results(*_sides(spark, d)).select(
        "video_hash", "confidence", "updated_at", "node"
    )


@query("tiered_source_lookup", """
SELECT q.video_hash, coalesce(m.confidence, t.confidence) AS confidence,
       CASE WHEN m.video_hash IS NOT NULL THEN 'local' WHEN t.video_hash IS NOT NULL THEN 'backend'
            ELSE 'none' END AS source
FROM media_fingerprints q LEFT JOIN mine m ON m.video_hash = q.video_hash AND m.variant < 2
LEFT JOIN theirs t ON t.video_hash = q.video_hash AND t.variant < 3""")
def _(spark, d):
    mine, theirs = _sides(spark, d)
    return lookup.tiered_source_lookup(
        derived.media_fingerprints(spark, d), mine.where("variant < 2"), theirs.where("variant < 3")
    )


# ---- lineage ------------------------------------------------------------------------------------


@query("find_family", """
SELECT h.left_hash AS q_code, h.right_hash AS r_code, h.distance, count(*) AS members,
       min(m.first_seen) AS first_seen
FROM hash_pairs h JOIN media_fingerprints m ON m.perceptual_hash = h.right_hash
WHERE h.distance <= 12 GROUP BY ALL""")
def _(spark, d):
    return lineage.find_family(derived.media_fingerprints(spark, d))


@query("family_plus_self", """
SELECT left_hash AS q_code, right_hash AS r_code FROM hash_pairs WHERE distance BETWEEN 1 AND 12
UNION SELECT perceptual_hash, perceptual_hash FROM media_fingerprints""")
def _(spark, d):
    items = derived.media_fingerprints(spark, d)
    pairs = lookup.near_duplicate_pairs(items, items, bits.FAMILY_THRESHOLD, "family")
    return lookup.family_plus_self(pairs.where("q_code <> r_code"), items)


@query("assign_parents", """
SELECT video_hash, parent_hash, distance,
       CASE WHEN parent_hash IS NULL THEN NULL WHEN distance BETWEEN 1 AND 5 THEN 'minor_compression'
            WHEN distance BETWEEN 6 AND 15 THEN 'moderate_edit'
            WHEN distance BETWEEN 16 AND 30 THEN 'significant_modification'
            WHEN distance > 30 THEN 'major_transformation' ELSE 'unknown_modification' END AS mutation
FROM media_parents""")
def _(spark, d):
    parents = lineage.assign_parents(derived.media_fingerprints(spark, d))
    return lineage.with_mutation(parents).select(
        "video_hash", "parent_hash", "distance", "mutation"
    )


def _family_pairs(spark, d):
    """The pairs of a family, written once: several parts of a query read them."""
    items = derived.media_fingerprints(spark, d)
    return cut_lineage(lookup.near_duplicate_pairs(items, items, bits.FAMILY_THRESHOLD, "family"))


def _parents(spark, d, pairs=None):
    """The parents, written once: pointer doubling reads them in every round."""
    parents = lineage.assign_parents(derived.media_fingerprints(spark, d), pairs=pairs)
    return cut_lineage(
        parents.select("video_hash", "perceptual_hash", "first_seen", "parent_hash", "distance")
    )


@query("generations", "SELECT video_hash, root_hash, generation FROM media_tree")
def _(spark, d):
    return lineage.generations(_parents(spark, d))


@query("find_origin", """
SELECT perceptual_hash, video_hash AS origin_hash, generation AS origin_generation,
       first_seen AS origin_first_seen
FROM (SELECT h.left_hash AS perceptual_hash, t.video_hash, t.generation, t.first_seen,
             row_number() OVER (PARTITION BY h.left_hash
               ORDER BY t.generation, t.first_seen, t.video_hash) AS rn
      FROM hash_pairs h JOIN media_tree t ON t.perceptual_hash = h.right_hash
      WHERE h.distance <= 12) WHERE rn = 1""")
def _(spark, d):
    pairs = _family_pairs(spark, d)
    nodes = _parents(spark, d, pairs)
    staged = nodes.join(lineage.generations(nodes), "video_hash")
    return lineage.find_origin(pairs, staged)


@query("family_facts", """
SELECT h.left_hash AS perceptual_hash, count(DISTINCT h.right_hash) - 1 AS n_links, count(*) AS members,
       min(m.first_seen) AS first_seen
FROM hash_pairs h JOIN media_fingerprints m ON m.perceptual_hash = h.right_hash
WHERE h.distance <= 12 GROUP BY 1""")
def _(spark, d):
    items = derived.media_fingerprints(spark, d)
    out = families.family_facts(items, families.fold_families(items), ["first_seen", "video_hash"])
    return out.select("perceptual_hash", "n_links", "members", F.col("first.first_seen").alias("first_seen"))


@query("family_origins", ORACLE["find_origin"])
def _(spark, d):
    """As ``find_origin``, by classes: no row for each pair of a family."""
    items = derived.media_fingerprints(spark, d)
    nodes = items.join(lineage.generations(_parents(spark, d)).drop("root_hash"), "video_hash")
    rank = ["generation", "first_seen", "video_hash"]
    out = families.family_facts(nodes, families.fold_families(items), rank)
    return out.select(
        "perceptual_hash",
        F.col("first.video_hash").alias("origin_hash"),
        F.col("first.generation").alias("origin_generation"),
        F.col("first.first_seen").alias("origin_first_seen"),
    )


@query("trace_to_origin", """
SELECT video_hash, step, ancestor AS ancestor_hash FROM (
  WITH RECURSIVE up AS (
    SELECT video_hash, 1 AS step, parent_hash AS ancestor FROM item_lineage
    WHERE parent_hash IN (SELECT video_hash FROM item_lineage)
    UNION ALL
    SELECT up.video_hash, step + 1, l.parent_hash FROM up JOIN item_lineage l ON l.video_hash = up.ancestor
    WHERE step < 10 AND l.parent_hash IN (SELECT video_hash FROM item_lineage))
  SELECT * FROM up)""")
def _(spark, d):
    rows = derived.item_lineage(spark, d)
    return lineage.trace_to_origin(rows, rows)


@query("classify_mutation", """
SELECT vec_id, av, bv, CASE WHEN d BETWEEN 1 AND 5 THEN 'minor_compression'
  WHEN d BETWEEN 6 AND 15 THEN 'moderate_edit' WHEN d BETWEEN 16 AND 30 THEN 'significant_modification'
  WHEN d > 30 THEN 'major_transformation' ELSE 'unknown_modification' END AS mutation FROM variant_distance""")
def _(spark, d):
    distance = bits.hamming(F.col("a"), F.col("b"), "family")
    return _variant_pairs(spark, d).select(
        "vec_id", "av", "bv", decide.classify_mutation(distance).alias("mutation")
    )


@query("quality_mutations", """
SELECT video_hash, coalesce(nullif(concat_ws(',',
         CASE WHEN (vec_id * 17) % 900 < 100 THEN 'heavy_compression'
              WHEN (vec_id * 17) % 900 < 500 THEN 'light_compression' END,
         CASE WHEN (vec_id * 13) % 100 > 50 THEN 'possible_watermark' END), ''), 'unknown_modification') AS mutations
FROM media_fingerprints""")
def _(spark, d):
    v = F.col("vec_id")
    found = decide.quality_mutations((v * 17) % 900, (v * 13) % 100)
    return derived.media_fingerprints(spark, d).select(
        "video_hash", F.array_join(found, ",").alias("mutations")
    )


@query("parent_child_edges", """
SELECT c.parent_hash, c.video_hash AS child_hash FROM item_lineage c
JOIN item_lineage p ON p.video_hash = c.parent_hash""")
def _(spark, d):
    return lineage.parent_child_edges(derived.item_lineage(spark, d))


@query("children_of", """
SELECT c.parent_hash, c.video_hash AS child_hash, count(*) OVER (PARTITION BY c.parent_hash) AS n_children
FROM item_lineage c JOIN item_lineage p ON p.video_hash = c.parent_hash""")
def _(spark, d):
    return lineage.children_of(derived.item_lineage(spark, d))


@query("family_roots", """
SELECT video_hash FROM media_parents WHERE parent_hash IS NULL""")
def _(spark, d):
    return lineage.family_roots(_parents(spark, d)).select("video_hash")


register("media_families", """
SELECT m.video_hash, c.component AS family_id FROM media_fingerprints m
JOIN media_components c ON c.perceptual_hash = m.perceptual_hash""")


def _components(spark, d, pairs=None):
    items = derived.media_fingerprints(spark, d)
    pairs = _family_pairs(spark, d) if pairs is None else pairs
    edges = pairs.where("q_code < r_code").select(
        F.col("q_code").alias("a"), F.col("r_code").alias("b")
    )
    nodes = items.select(F.col("perceptual_hash").alias("node")).distinct()
    return lineage.family_components(edges, nodes)


@query("family_components", """
SELECT component AS family_id, count(*) AS members FROM media_components GROUP BY 1""")
def _(spark, d):
    parts = _components(spark, d)
    return parts.groupBy(F.col("component").alias("family_id")).agg(
        F.count(F.lit(1)).alias("members")
    )


@query("folded_components", ORACLE["family_components"])
def _(spark, d):
    parts = families.folded_components(families.fold_families(derived.media_fingerprints(spark, d)))
    return parts.groupBy(F.col("component").alias("family_id")).agg(F.count(F.lit(1)).alias("members"))


@query("family_tree", """
SELECT f.family_id, t.root_hash, t.video_hash, t.parent_hash, t.generation::INT AS generation, t.path
FROM media_tree t JOIN media_families f ON f.video_hash = t.video_hash
UNION ALL
SELECT family_id, 'Multiple Origins', 'Multiple Origins', NULL, -1, '' FROM (
  SELECT f.family_id FROM media_tree t JOIN media_families f ON f.video_hash = t.video_hash
  WHERE t.generation = 0 GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, d):
    pairs = _family_pairs(spark, d)
    nodes = _parents(spark, d, pairs)
    parts = _components(spark, d, pairs).withColumnsRenamed(
        {"node": "perceptual_hash", "component": "family_id"}
    )
    families = derived.media_fingerprints(spark, d).join(parts, "perceptual_hash").select(
        "video_hash", "family_id"
    )
    return lineage.family_tree(nodes, families).select(
        "family_id", "root_hash", "video_hash", "parent_hash", "generation", "path"
    )


def _lineage_requests(spark, d):
    """Registration requests: item lineage once more in reverse, and unknown children twice."""
    rows = derived.item_lineage(spark, d)
    again = rows.where("generation > 1").select(
        F.col("video_hash").alias("child_hash"), "parent_hash",
        F.col("first_seen").alias("registered_at"), F.lit(1).alias("request_id"),
    )
    fresh = rows.withColumn("request_id", F.explode(F.array(F.lit(2), F.lit(3)))).select(
        F.sha2(F.concat("video_hash", F.lit("-copy")), 256).alias("child_hash"),
        F.when(F.col("request_id") == 2, F.col("video_hash"))
        .otherwise(F.col("parent_hash"))
        .alias("parent_hash"),
        F.col("first_seen").alias("registered_at"),
        "request_id",
    )
    return again.unionByName(fresh)


@query("register_lineage", """
SELECT sha256(video_hash || '-copy') AS child_hash, video_hash AS parent_hash,
       first_seen AS registered_at, 2 AS request_id FROM item_lineage""")
def _(spark, d):
    return lineage.register_lineage(
        derived.item_lineage(spark, d), _lineage_requests(spark, d)
    ).select("child_hash", "parent_hash", "registered_at", "request_id")


@query("validate_lineage", """
SELECT sha256(video_hash || '-copy') AS child_hash, 'ok' AS status, 2 AS request_id FROM item_lineage
UNION ALL SELECT sha256(video_hash || '-copy'), 'ok', 3 FROM item_lineage
UNION ALL SELECT video_hash, 'lineage already registered', 1 FROM item_lineage WHERE generation > 1""")
def _(spark, d):
    known = derived.item_lineage(spark, d).select(
        F.col("video_hash").alias("child_hash"), F.lit(1).alias("_k")
    )
    rows = _lineage_requests(spark, d).join(known, "child_hash", "left")
    status = (
        F.when(decide.is_zero_hash(F.col("child_hash")), "invalid child hash")
        .when(F.col("_k") == 1, "lineage already registered")
        .otherwise("ok")
    )
    return rows.select("child_hash", status.alias("status"), "request_id")


# ---- registry and statistics ----------------------------------------------------------------------


def _upload_batch(spark, d):
    """A batch of detections: some items are registered already, some arrive twice."""
    return (
        derived.detections(spark, d)
        .where("is_deepfake")
        .withColumn("event_id", F.explode(F.expr("sequence(0, CAST(vec_id % 2 AS INT))")))
        .withColumn("seen_at", F.expr("timestampadd(DAY, 200 + event_id, first_seen)"))
    )


register("upload_batch", """
SELECT d.*, k AS event_id, first_seen + to_days((200 + k)::INT) AS seen_at FROM (
  SELECT *, unnest(range(1 + vec_id % 2)) AS k FROM detections WHERE is_deepfake) d""")

UPSERTED = """
SELECT coalesce(r.video_hash, b.video_hash) AS video_hash,
       CASE WHEN b.video_hash IS NOT NULL THEN b.confidence ELSE r.confidence END AS confidence,
       coalesce(r.first_seen, b.fs) AS first_seen,
       greatest(r.last_seen, b.ls) AS last_seen,
       coalesce(r.detection_count, 0) + coalesce(b.n, 0) AS detection_count
FROM registry r FULL JOIN (SELECT video_hash, max(confidence) AS confidence, min(seen_at) AS fs,
  max(seen_at) AS ls, count(*) AS n FROM upload_batch GROUP BY 1) b ON b.video_hash = r.video_hash"""


@query("upsert_registry", UPSERTED)
def _(spark, d):
    out = registry.upsert_registry(derived.registry(spark, d), _upload_batch(spark, d))
    return out.select("video_hash", "confidence", "first_seen", "last_seen", "detection_count")


@query("registry_of_deltas", UPSERTED)
def _(spark, d):
    """The same registry, from a base and a delta that are merged as they are read."""
    out, known = scratch_path(spark, "registry"), derived.registry(spark, d).select(*registry_store.COLUMNS)
    registry_store.append(known, out, -1)
    folded = registry.fold_batch(_upload_batch(spark, d))
    registry_store.append(folded.select(*[F.col(f.name).cast(f.dataType) for f in known.schema.fields]), out, 0)
    rows = registry_store.read(spark, out, known.schema)
    return rows.select("video_hash", "confidence", "first_seen", "last_seen", "detection_count")


@query("load_fingerprints", """
SELECT video_hash, perceptual_hash, is_deepfake, confidence, first_seen, detection_count FROM registry""")
def _(spark, d):
    path = scratch_path(spark, "fingerprints")
    derived.registry(spark, d).write.parquet(path)
    return tables.load_fingerprints(spark, path).select(
        "video_hash", "perceptual_hash", "is_deepfake", "confidence", "first_seen", "detection_count"
    )


@query("load_lineage", """
SELECT video_hash, parent_hash, generation, first_seen, source_platform, is_deepfake FROM item_lineage""")
def _(spark, d):
    path = scratch_path(spark, "lineage")
    derived.item_lineage(spark, d).write.parquet(path)
    return tables.load_lineage(spark, path).select(
        "video_hash", "parent_hash", "generation", "first_seen", "source_platform", "is_deepfake"
    )


@query("load_sightings", """
SELECT event_id, ts, video_hash, ip_hash, country, city, platform FROM sightings""")
def _(spark, d):
    path = scratch_path(spark, "sightings")
    derived.sightings(spark, d).write.parquet(path)
    return tables.load_sightings(spark, path).select(
        "event_id", "ts", "video_hash", "ip_hash", "country", "city", "platform"
    )


@query("export_json", """
SELECT video_hash, perceptual_hash, is_deepfake, confidence, last_seen, detection_count FROM registry""")
def _(spark, d):
    rows = derived.registry(spark, d).select(
        "video_hash", "perceptual_hash", "is_deepfake", "confidence", "last_seen", "detection_count"
    )
    return tables.export_json(rows, scratch_path(spark, "export"))


@query("registry_stats", """
SELECT count(*) AS total_entries, count(*) FILTER (WHERE is_deepfake) AS deepfake_count,
       sum(detection_count)::BIGINT AS total_lookups, round(avg(confidence), 6) AS average_confidence,
       count(*) FILTER (WHERE NOT is_deepfake) AS authentic_count,
       (sum(detection_count) - count(*))::BIGINT AS cache_hits,
       round((sum(detection_count) - count(*)) / sum(detection_count), 6) AS cache_hit_rate FROM registry""")
def _(spark, d):
    return rounded(
        stats.registry_stats(derived.registry(spark, d)), "average_confidence", "cache_hit_rate"
    )


@query("registry_totals", """
SELECT count(*) AS total, count(*) FILTER (WHERE is_deepfake) AS deepfakes,
       count(*) FILTER (WHERE NOT is_deepfake) AS authentic FROM registry""")
def _(spark, d):
    return stats.registry_totals(derived.registry(spark, d))


@query("lineage_by_verdict", "SELECT is_deepfake, count(*) AS count FROM item_lineage GROUP BY 1")
def _(spark, d):
    return stats.lineage_by_verdict(derived.item_lineage(spark, d))


@query("generation_histogram", "SELECT generation, count(*) AS count FROM media_tree GROUP BY 1")
def _(spark, d):
    return stats.generation_histogram(lineage.generations(_parents(spark, d)))


@query("lineage_summary", """
SELECT count(*) AS total_videos, count(*) FILTER (WHERE is_deepfake) AS deepfakes,
       count(*) FILTER (WHERE NOT is_deepfake) AS authentic,
       count(*) FILTER (WHERE generation = 0) AS unique_families,
       round((count(*) - count(*) FILTER (WHERE generation = 0))
             / greatest(count(*) FILTER (WHERE generation = 0), 1), 6) AS avg_mutations_per_family
FROM item_lineage""")
def _(spark, d):
    return rounded(
        stats.lineage_summary(derived.item_lineage(spark, d)), "avg_mutations_per_family"
    )


@query("dashboard", """
SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE is_deepfake) AS deepfakes_found,
       round(avg(processing_time), 6) AS avg_processing_time,
       round(count(*) FILTER (WHERE is_deepfake) / count(*) * 100, 6) AS detection_rate,
       count(*) FILTER (WHERE is_deepfake) AS threat_count FROM detections""")
def _(spark, d):
    return rounded(
        stats.dashboard(derived.detections(spark, d)), "avg_processing_time", "detection_rate"
    )


NOW = "TIMESTAMP_NTZ'2024-05-01 00:00:00'"


@query("retention", """
SELECT video_hash, last_seen FROM registry WHERE last_seen >= TIMESTAMP '2024-05-01' - INTERVAL 90 DAY""")
def _(spark, d):
    out = registry.retention(derived.registry(spark, d), "last_seen", F.expr(NOW), 90)
    return out.select("video_hash", "last_seen")


@query("retention_report", """
SELECT count(*) FILTER (WHERE last_seen >= TIMESTAMP '2024-05-01' - INTERVAL 90 DAY) AS kept,
       count(*) FILTER (WHERE last_seen < TIMESTAMP '2024-05-01' - INTERVAL 90 DAY) AS removed FROM registry""")
def _(spark, d):
    return registry.retention_report(derived.registry(spark, d), "last_seen", F.expr(NOW), 90)


@query("latest_per_key", """
SELECT content_hash, doc_id, seen_at, source FROM (SELECT *, row_number() OVER (PARTITION BY content_hash
  ORDER BY seen_at DESC, doc_id DESC) AS rn FROM uploads) WHERE rn = 1""")
def _(spark, d):
    return registry.latest_per_key(
        derived.uploads(spark, d), "content_hash", ["seen_at", "doc_id"]
    )


@query("exact_duplicate_groups", """
SELECT content_hash, count(*) AS times_seen, min(seen_at) AS first_seen, max(seen_at) AS last_seen
FROM uploads GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return stats.exact_duplicate_groups(derived.uploads(spark, d))


@query("forensic_report", """
WITH RECURSIVE up AS (
  SELECT video_hash AS v, video_hash AS r FROM item_lineage WHERE parent_hash IS NULL
  UNION ALL SELECT c.video_hash, up.r FROM up JOIN item_lineage c ON c.parent_hash = up.v),
fam AS (SELECT r, count(*) AS n FROM up GROUP BY r)
SELECT l.video_hash, 'Video Hash: ' || substr(l.video_hash, 1, 32) || '...' || chr(10)
  || 'First Seen: ' || strftime(l.first_seen, '%Y-%m-%d %H:%M:%S') || chr(10)
  || 'Platform: ' || l.source_platform || chr(10)
  || 'Status: ' || CASE WHEN l.is_deepfake THEN 'DEEPFAKE DETECTED' ELSE 'Appears Authentic' END || chr(10)
  || 'Verdict: ' || CASE
       WHEN l.is_deepfake THEN CASE WHEN l.confidence >= 0.9 THEN 'HIGHLY LIKELY DEEPFAKE'
         WHEN l.confidence >= 0.7 THEN 'LIKELY DEEPFAKE' WHEN l.confidence >= 0.5 THEN 'POSSIBLY DEEPFAKE'
         ELSE 'SUSPECTED DEEPFAKE (LOW CONFIDENCE)' END
       ELSE CASE WHEN l.confidence >= 0.9 THEN 'HIGHLY LIKELY AUTHENTIC'
         WHEN l.confidence >= 0.7 THEN 'LIKELY AUTHENTIC' WHEN l.confidence >= 0.5 THEN 'POSSIBLY AUTHENTIC'
         ELSE 'UNCLEAR - MANUAL REVIEW RECOMMENDED' END END || chr(10)
  || 'Confidence: ' || (floor(l.confidence * 1000 + 0.5::DOUBLE)::BIGINT // 10)::VARCHAR || '.'
  || (floor(l.confidence * 1000 + 0.5::DOUBLE)::BIGINT % 10)::VARCHAR || '%' || chr(10)
  || 'Origin Hash: ' || substr(up.r, 1, 32) || '...' || chr(10)
  || 'Origin Date: ' || strftime(o.first_seen, '%Y-%m-%d %H:%M:%S') || chr(10)
  || 'Origin Platform: ' || o.source_platform || chr(10)
  || 'Current Generation: ' || l.generation::VARCHAR || ' (0 = original)' || chr(10)
  || 'Total Family Members: ' || fam.n::VARCHAR || chr(10)
  || CASE WHEN l.generation > 0 THEN 'Detected Mutations:' || chr(10)
       || CASE WHEN l.generation = 1 THEN '  * Light Compression' ELSE '  * Heavy Compression' END || chr(10) ELSE '' END
  || e.lines
  || CASE WHEN e.n > 5 THEN chr(10) || '  ... and ' || (e.n - 5)::VARCHAR || ' more events' ELSE '' END AS report
FROM item_lineage l JOIN up ON up.v = l.video_hash JOIN fam ON fam.r = up.r
JOIN item_lineage o ON o.video_hash = up.r
JOIN (SELECT r, count(*) AS n, string_agg('  ' || strftime(ts, '%Y-%m-%d') || ' | '
        || rpad(platform, 12, ' ') || ' | Gen ' || generation::VARCHAR, chr(10) ORDER BY ts, event_id)
        FILTER (WHERE rn <= 5) AS lines
      FROM (SELECT s.*, up.r, i.generation, row_number() OVER (PARTITION BY up.r ORDER BY s.ts, s.event_id) AS rn
            FROM sightings s JOIN item_lineage i ON i.video_hash = s.video_hash JOIN up ON up.v = s.video_hash)
      GROUP BY 1) e ON e.r = up.r""")
def _(spark, d):
    rows = derived.item_lineage(spark, d)
    laplacian = F.when(F.col("generation") == 1, 300).otherwise(50)
    labels = F.when(F.col("generation") > 0, decide.quality_mutations(laplacian, F.lit(0)))
    rows = rows.withColumn("mutations", labels)
    roots = lineage.generations(rows).select("video_hash", F.col("root_hash").alias("origin_hash"))
    sizes = roots.groupBy("origin_hash").agg(F.count(F.lit(1)).alias("family_members"))
    members = roots.join(sizes, "origin_hash").select("video_hash", "family_members")
    return stats.forensic_report(rows, roots, members, derived.sightings(spark, d))


@query("sample_indices", """
SELECT video_id, n, array_to_string(CASE WHEN n < 7 THEN range(n)
       ELSE list_transform(range(7), lambda i: i * (n - 1) // 6) END, ',') AS indices
FROM (SELECT video_id, count(*) AS n FROM frames GROUP BY 1)""")
def _(spark, d):
    lengths = derived.frames(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    picks = arrays.sample_indices(F.col("n"), 7)
    return lengths.select("video_id", "n", F.array_join(picks, ",").alias("indices"))


@query("sql_functions", """
SELECT p.vec_id, p.av, p.bv, p.d AS distance, m.vec_id % 2 = 0 AS fake_guess,
       CASE WHEN m.vec_id % 2 = 0 THEN 'LIKELY DEEPFAKE' ELSE 'LIKELY AUTHENTIC' END AS verdict,
       sha256('pepper' || m.video_hash) AS salted
FROM variant_distance p JOIN media_fingerprints m ON m.vec_id = p.vec_id AND m.variant = p.av""")
def _(spark, d):
    register_sql_functions(spark)
    names = derived.media_fingerprints(spark, d).select(
        "vec_id", F.col("variant").alias("av"), "video_hash"
    )
    rows = _variant_pairs(spark, d).join(names, ["vec_id", "av"])
    return rows.selectExpr(
        "vec_id", "av", "bv",
        "media_hamming(a, b) AS distance",
        "vec_id % 2 = 0 AS fake_guess",
        "media_verdict(vec_id % 2 = 0, 0.75D) AS verdict",
        "media_ip_hash(video_hash, 'pepper') AS salted",
    )
