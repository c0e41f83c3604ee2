"""Clusters of places against the distances of all pairs, on a small fixture."""

import math
import random

from trailmark.operators.places import EARTH_KM, radius_clusters


def km(p, q):
    (a, b), (c, d) = ([math.radians(x) for x in v] for v in (p, q))
    h = math.sin((a - c) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((b - d) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def clusters(spark, places, radius):
    rows = [(k, *(None if x is None else float(x) for x in p)) for k, p in enumerate(places)]
    got = radius_clusters(spark.createDataFrame(rows, "id int, latitude double, longitude double"), radius)
    return {r.id: r.cluster for r in got.collect()}


def test_places_within_the_radius_share_a_cluster_and_far_ones_do_not(spark):
    draw = random.Random(7)
    seeds = [(0, 0), (0, 180), (45, 179.95), (89.9, 10), (-89.7, -60), (60, -180), (-33, 20), (71.3, 0.1)]
    places = [(max(-90, min(90, a + draw.gauss(0, 1.5))), (b + draw.gauss(0, 3) + 540) % 360 - 180) for a, b in seeds for _ in range(30)]
    places += [(90, 0), (90, 120), (-90, 5), (0, 179.9999), (0, -180), (12.5, 77.2), (12.5, 77.2)]
    of = clusters(spark, places, 50.0)
    assert len(of) == len(places)
    left = {k: k for k in of}

    def root(k, parents):
        while parents[k] != k:
            k = parents[k]
        return k

    # within the radius: one cluster; in one cluster: chained by steps of less than the diagonal of a few cells
    for a in of:
        for b in range(a):
            far = km(places[a], places[b])
            assert far > 50.0 or of[a] == of[b]
            if far <= 50.0 * 9:
                left[root(a, left)] = root(b, left)
    assert len(set(of.values())) > 8
    assert all(root(a, left) == root(b, left) for a in of for b in of if of[a] == of[b])


def test_places_off_the_globe_are_left_out(spark):
    places = [(None, 1.0), (1.0, None), (91.0, 0.0), (float("nan"), 0.0), (1.0, 2.0), (1.0, 362.0 - 360)]
    of = clusters(spark, places, 50.0)
    assert sorted(of) == [4, 5] and of[4] == of[5]
    assert clusters(spark, [(None, None)], 50.0) == {}
