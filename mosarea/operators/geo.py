"""District geometry: point assignment, centroids, contiguity, ICAR structure. Districts are sets of rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mosarea.operators.aggregates import dense_index
from mosarea.operators.joins import keep_members
from mosarea.session import cut_lineage
from mosarea.sources.tables import settle_dimension

SNAP = 1e-8


def ring_edges(districts: DataFrame, key: str = "adm2_index") -> DataFrame:
    """Directed edges ``(key, ring_no, k, x1, y1, x2, y2)`` of each ring, closed if left open.

    A district may have several rings, numbered by a column ``ring_no``: parts, holes, parts in holes.
    """
    ring = F.col("ring")
    number = F.col("ring_no") if "ring_no" in districts.columns else F.lit(1).alias("ring_no")
    closed = F.when(
        F.element_at(ring, 1) == F.element_at(ring, -1), ring
    ).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    numbered = districts.select(key, number, closed.alias("p")).select(
        key,
        "ring_no",
        F.posexplode(
            F.arrays_zip(
                F.slice(F.col("p"), F.lit(1), F.size("p") - 1).alias("a"),
                F.slice(F.col("p"), F.lit(2), F.size("p") - 1).alias("b"),
            )
        ).alias("k", "e"),
    )
    return numbered.select(
        key,
        "ring_no",
        (F.col("k") + 1).alias("k"),
        F.col("e.a.x").alias("x1"),
        F.col("e.a.y").alias("y1"),
        F.col("e.b.x").alias("x2"),
        F.col("e.b.y").alias("y2"),
    )


#: a square with more edges is cut in four, up to this depth
SQUARE_EDGES, DEPTH = 32, 12


class Quadtree:
    """Squares that follow the density of edges: many where borders are detailed, few where they are straight."""

    def __init__(self, edges: DataFrame, key: str, square_edges: int = SQUARE_EDGES, depth: int = DEPTH):
        ends = [F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")]
        x_lo, x_hi, y_lo, y_hi = edges.agg(F.min(ends[0]), F.max(ends[1]), F.min(ends[2]), F.max(ends[3])).first()
        self.empty = x_lo is None
        if self.empty:
            return
        self.x_lo, self.y_lo, self.side = x_lo, y_lo, max(x_hi - x_lo, y_hi - y_lo) or 1.0
        levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
        middle = edges.select(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), levels)
        placed = middle.select("level", self.column("x", "level").alias("gx"), self.row("y", "level").alias("gy"))
        full = cut_lineage(placed.groupBy("level", "gx", "gy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > square_edges).drop("n"))
        quarter = F.explode(F.sequence(F.lit(0), F.lit(3)))
        parts = full.withColumn("q", quarter).select(
            (F.col("level") + 1).alias("level"), (2 * F.col("gx") + F.col("q") % 2).alias("gx"), (2 * F.col("gy") + F.floor(F.col("q") / 2)).alias("gy")
        )
        root = edges.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("gx"), F.lit(0).cast("bigint").alias("gy"))
        leaves = cut_lineage(root.unionByName(parts).join(full, ["level", "gx", "gy"], "left_anti"))
        #: at most ``depth`` + 1 numbers
        self.levels = sorted(r[0] for r in leaves.select("level").distinct().collect())
        # squares of one country: settled so that points are not shuffled to meet them
        self.squares = settle_dimension(self._candidates(edges, key, leaves))

    def _at(self, value: str, low: float, level) -> Column:
        cells = F.pow(F.lit(2.0), F.col(level) if isinstance(level, str) else F.lit(level))
        return F.least(F.floor((F.col(value) - low) / self.side * cells), cells - 1).cast("bigint")

    def column(self, x: str, level) -> Column:
        return self._at(x, self.x_lo, level)

    def row(self, y: str, level) -> Column:
        return self._at(y, self.y_lo, level)

    def holds(self, x: str, y: str) -> Column:
        return F.col(x).between(self.x_lo, self.x_lo + self.side) & F.col(y).between(self.y_lo, self.y_lo + self.side)

    def _candidates(self, edges: DataFrame, key: str, leaves: DataFrame) -> DataFrame:
        """One row per square: polygons whose box meets it, with the edges that a ray going right
        from inside the square can cross."""
        box = edges.groupBy(key).agg(F.min(F.least("x1", "x2")).alias("x_from"))
        levels = F.array(*[F.lit(v) for v in self.levels])
        ends = {"x_to": F.greatest("x1", "x2"), "y_from": F.least("y1", "y2"), "y_to": F.greatest("y1", "y2")}
        strips = edges.withColumns(ends).join(box, key).withColumn("level", F.explode(levels))
        strips = strips.select(
            key,
            "level",
            F.struct("x1", "y1", "x2", "y2").alias("edge"),
            self.column("x_from", "level").alias("first"),
            self.column("x_to", "level").alias("last"),
            F.explode(F.sequence(self.row("y_from", "level"), self.row("y_to", "level"))).alias("gy"),
        )
        met = strips.join(leaves, ["level", "gy"]).where((F.col("first") <= F.col("gx")) & (F.col("gx") <= F.col("last")))
        polygons = met.groupBy("level", "gx", "gy", key).agg(F.collect_list("edge").alias("edges"))
        return polygons.groupBy("level", "gx", "gy").agg(F.collect_list(F.struct(F.col(key).alias("polygon"), "edges")).alias("polygons"))


def assign_points(
    points: DataFrame, edges: DataFrame, x: str, y: str, key: str = "adm2_index", square_edges: int = SQUARE_EDGES
) -> DataFrame:
    """Left spatial join of points to polygons; unmatched points keep a null key.

    Points meet a table with at most one row per square of a quadtree, so the joins (one per size
    of square) are equi joins that never multiply points, and the crossing test runs inside
    the row. Inside is where a ray crosses the rings of a district an odd number of times, so
    holes are outside and parts in them inside. Borders are half open: a point on a shared
    border gets one polygon.
    """
    tree = Quadtree(edges, key, square_edges)
    kind = edges.schema[key].dataType
    if tree.empty:
        return points.withColumn(key, F.lit(None).cast(kind))
    located, found = points, []
    for level in tree.levels:
        squares = tree.squares.where(F.col("level") == level).select("gx", "gy", F.col("polygons").alias(f"__{level}"))
        place = {"gx": F.when(tree.holds(x, y), tree.column(x, level)), "gy": F.when(tree.holds(x, y), tree.row(y, level))}
        located = located.withColumns(place).join(squares, ["gx", "gy"], "left").drop("gx", "gy")
        found.append(f"__{level}")
    px, py = F.col(x), F.col(y)

    def crosses(e):
        straddles = (e["y1"] > py) != (e["y2"] > py)
        at = e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return straddles & F.coalesce(px < at, F.lit(False))

    inside = F.filter(F.coalesce(*found), lambda c: F.size(F.filter(c["edges"], crosses)) % 2 == 1)
    polygons = F.transform(inside, lambda c: c["polygon"])
    return located.withColumn(key, F.explode_outer(polygons)).drop(*found)


def ring_signs(edges: DataFrame, key: str = "adm2_index") -> DataFrame:
    """``(key, ring_no, sign)``: -1 for a hole, that is a ring inside an odd number of the district's other rings."""
    corner = edges.where("k = 1").select(key, F.col("ring_no").alias("own"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("x2").alias("qx"), F.col("y2").alias("qy"))
    # the middle of an edge: a corner may touch the ring around it
    middle = corner.select(key, "own", ((F.col("px") + F.col("qx")) / 2).alias("px"), ((F.col("py") + F.col("qy")) / 2).alias("py"))
    others = middle.join(edges, key).where("own <> ring_no and (y1 > py) <> (y2 > py)")
    right = others.where(F.col("px") < F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    around = right.groupBy(key, "own").agg(F.count(F.lit(1)).alias("n"))
    return middle.join(around, [key, "own"], "left").select(
        key, F.col("own").alias("ring_no"), F.when(F.coalesce("n", F.lit(0)) % 2 == 1, -1.0).otherwise(1.0).alias("sign")
    )


def centroids(edges: DataFrame, key: str = "adm2_index") -> DataFrame:
    """Area centroid of each district (planar shoelace sums); holes count against it, whichever way they turn."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges.groupBy(key, "ring_no").agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("my")
    )
    signed = rings.join(ring_signs(edges, key), [key, "ring_no"]).withColumn("sign", F.col("sign") * F.signum("a"))
    sums = signed.groupBy(key).agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("a", "mx", "my")])
    return sums.select(key, (F.col("mx") / (3 * F.col("a"))).alias("lon"), (F.col("my") / (3 * F.col("a"))).alias("lat"))


def contiguity(edges: DataFrame, key: str = "adm2_index", snap: float = SNAP) -> DataFrame:
    """Ordered pairs of polygons that share a boundary vertex (both directions)."""
    vertices = edges.select(
        key,
        F.round(F.col("x1") / snap).cast("bigint").alias("vx"),
        F.round(F.col("y1") / snap).cast("bigint").alias("vy"),
    ).distinct()
    other = vertices.withColumnRenamed(key, "__other")
    return (
        vertices.join(other, ["vx", "vy"])
        .where(F.col(key) != F.col("__other"))
        .select(F.col(key).alias("node1"), F.col("__other").alias("node2"))
        .distinct()
    )


def undirected_edges(neighbours: DataFrame) -> DataFrame:
    """Edge list with node1 < node2."""
    return neighbours.where(F.col("node1") < F.col("node2")).orderBy("node1", "node2")


def islands(districts: DataFrame, neighbours: DataFrame, key: str = "adm2_index") -> DataFrame:
    return districts.select(key).join(neighbours.select(F.col("node1").alias(key)), key, "left_anti")


def icar_structure(neighbours: DataFrame) -> DataFrame:
    """Coordinate rows ``(row, col, value)`` of degree minus adjacency."""
    degree = neighbours.groupBy("node1").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return degree.select(F.col("node1").alias("row"), F.col("node1").alias("col"), "value").unionByName(
        neighbours.select(F.col("node1").alias("row"), F.col("node2").alias("col"), F.lit(-1.0).alias("value"))
    )


def region_index(districts: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Surveyed districts with dense district and province indices, both by name."""
    kept = keep_members(districts, surveyed, "adm2_name").select("adm1_name", "adm2_name").distinct()
    by_district = dense_index(kept, "adm2_name", "adm2_index")
    by_province = dense_index(kept, "adm1_name", "adm1_index")
    return kept.join(by_district, "adm2_name").join(by_province, "adm1_name")
