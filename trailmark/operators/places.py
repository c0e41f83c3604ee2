"""Groups of near places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.lineage import family_components
from trailmark.sources.rules import GEO_RULES

EARTH_KM = 6371.0088


def radius_clusters(sightings: DataFrame, radius_km: float = GEO_RULES["cluster_radius_km"]) -> DataFrame:
    """Sightings with ``cell`` and ``cluster``: those within the radius of one another share a cluster, wherever cells end.

    Cells are at least a radius high and wide everywhere in their row, so places within the radius are in one
    cell or in cells that touch within it, over the date line and the poles too. Occupied cells that do are
    joined, and clusters are their connected components, named by the least cell. Events are never paired:
    the work after the first aggregate is on cells, each of which has a bounded number of neighbours.
    Rows without a place on the globe are left out.
    """
    angle = radius_km / EARTH_KM
    step = math.degrees(angle)
    half = math.sin(min(angle, math.pi) / 2)

    def edge(row: Column) -> Column:
        """The latitude of the row's side that is nearer to a pole."""
        return F.least(F.greatest(F.abs(row), F.abs(row + 1)) * step, F.lit(90.0))

    def reach(row: Column) -> Column:
        """Degrees of longitude that places of the row within the radius can be apart, at most."""
        width = F.cos(F.radians(edge(row)))
        return F.when((edge(row) >= 90) | (width <= half), F.lit(360.0)).otherwise(2 * F.degrees(F.asin(half / width)))

    def columns(row: Column) -> Column:
        return F.greatest(F.floor(360 / reach(row)), F.lit(1))

    row, col = F.col("_row"), F.col("_col")
    east = F.pmod(F.col("longitude") + 180, F.lit(360.0))
    placed = sightings.where("abs(latitude) <= 90 and abs(longitude) <= 360").withColumn("_row", F.floor(F.col("latitude") / step))
    # a place just below 360 degrees may be rounded up to them
    placed = placed.withColumn("_col", F.least(F.floor(east / (360 / columns(row))), columns(row) - 1))
    placed = placed.withColumn("cell", F.concat_ws(":", row, col))
    cells = placed.select("_row", "_col", "cell").distinct()

    width = 360 / columns(row)
    beside = cells.select(F.col("cell").alias("a"), row.alias("_row"), F.pmod(col + 1, columns(row)).alias("_col"))
    # a cell looks for those of the rows beside it that are not nearer to a pole: its own reach is the larger
    other = F.col("_other")
    toward = cells.select("*", F.explode(F.array(row - 1, row + 1)).alias("_other")).where(edge(other) <= edge(row))
    low = F.floor((col * width - reach(row)) / (360 / columns(other)))
    high = F.floor(((col + 1) * width + reach(row)) / (360 / columns(other)))
    across = toward.select(
        F.col("cell").alias("a"),
        other.alias("_row"),
        F.explode(F.transform(F.sequence(low, F.least(high, low + columns(other) - 1)), lambda c: F.pmod(c, columns(other)))).alias("_col"),
    )
    edges = beside.unionByName(across).join(cells, ["_row", "_col"]).select("a", F.col("cell").alias("b"))
    groups = family_components(edges, cells.select(F.col("cell").alias("node")))
    named = groups.select(F.col("node").alias("cell"), F.col("component").alias("cluster"))
    return placed.drop("_row", "_col").join(named, "cell").select(*sightings.columns, "cell", "cluster")
