"""Points and polygons on built-in expressions (inventory J15, J16, area and centroid of D14).

Polygons enter as vertex rows (poly_id, ring, seq, x, y) and become one row with an edge array. Candidates are found by
bounding boxes in a hierarchy of grids; an outline meets only the points whose box test it passed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hearthstat.operators.scale import held, stage

# Fixed value: radius of the web-map projection in metres.
EARTH_RADIUS = 6378137.0


def shapes(vertices: DataFrame) -> DataFrame:
    """One row per polygon with its edges (all rings) and bounding box."""
    ring = vertices.groupBy("poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))

    def edge(p: Column, i: Column) -> Column:
        q = F.element_at("v", (i + 1) % F.size("v") + 1)
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return ring.withColumn("edges", F.transform("v", edge)).groupBy("poly_id").agg(
        F.flatten(F.collect_list("edges")).alias("edges"),
        F.min(F.array_min(F.transform("v", lambda p: p["x"]))).alias("min_x"),
        F.max(F.array_max(F.transform("v", lambda p: p["x"]))).alias("max_x"),
        F.min(F.array_min(F.transform("v", lambda p: p["y"]))).alias("min_y"),
        F.max(F.array_max(F.transform("v", lambda p: p["y"]))).alias("max_y"))


def outline_text(vertices: DataFrame) -> DataFrame:
    """Well-known text of each polygon, for exports; rings in order, each closed."""
    def point(p: Column) -> Column:
        return F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))

    ring = vertices.groupBy("poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    first, last = F.col("v")[0], F.element_at("v", -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("v")).otherwise(
        F.concat("v", F.array(first)))
    text = F.concat(F.lit("("), F.array_join(F.transform(closed, point), ", "), F.lit(")"))
    rings = ring.select("poly_id", "ring", text.alias("t")).groupBy("poly_id").agg(
        F.array_sort(F.collect_list(F.struct("ring", "t"))).alias("r"))
    inner = F.array_join(F.transform("r", lambda r: r["t"]), ", ")
    return rings.select("poly_id", F.concat(F.lit("POLYGON ("), inner, F.lit(")")).alias("geometry_wkt"))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the outline an odd number of times."""
    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def outline_distance(edges: Column, x: Column, y: Column) -> Column:
    """Smallest distance from a point to any edge."""
    def distance(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    return F.array_min(F.transform(edges, distance))


CROWD = 16
SPLITS = 6
KEY = ("_lx", "_ly", "_cx", "_cy")


def _level(low: str, high: str) -> Column:
    """Exponent of the narrowest power of two that is as wide as the extent, but not too fine for a whole number of cells."""
    widest = F.greatest(F.abs(low), F.abs(high))
    own, least = F.ceil(F.log2(F.col(high) - F.col(low))), F.ceil(F.log2(widest)) - 50  # the logarithm of 0 is NULL
    return F.coalesce(F.greatest(own, least), F.lit(0)).cast("int")


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c * F.pow(F.lit(2.0), -level)).cast("long")


def _covering(boxes: DataFrame) -> DataFrame:
    """Boxes with each cell of their levels that they touch."""
    def cells_of(axis: str) -> Column:
        level = F.col(f"_l{axis}")
        first, last = (_cell(F.col(f"{end}_{axis}"), level) for end in ("min", "max"))
        if f"_c{axis}" in boxes.columns:  # parts of a cell that was split: two at most along each axis
            half = F.col(f"_c{axis}") * 2
            first, last = F.greatest(first, half), F.least(last, half + 1)
        return F.explode(F.sequence(first, last))

    kept = [c for c in boxes.columns if c not in ("_cx", "_cy")]
    across = boxes.select(*kept, *([F.col("_cy")] if "_cy" in boxes.columns else []), cells_of("x").alias("_nx"))
    return across.select(*kept, F.col("_nx").alias("_cx"), cells_of("y").alias("_ny")).withColumnRenamed("_ny", "_cy")


def cells(polygons: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The cells (_lx, _ly, _cx, _cy) of a hierarchy of grids that cover each polygon's box, with id and box.

    Every polygon lies in the grid whose cells are the narrowest powers of two as wide and as high as its own box, so it
    touches at most three cells along each axis and no other polygon's size matters. A cell of more than ``crowd`` boxes
    hands them to its quarters, each box to those it touches, up to ``SPLITS`` times; a quarter is a cell of the grid one
    level finer. The cells of one polygon never overlap.
    """
    edges = ("min_x", "max_x", "min_y", "max_y")
    boxes = polygons.select("poly_id", *edges, _level("min_x", "max_x").alias("_lx"), _level("min_y", "max_y").alias("_ly"))
    table = stage(_covering(boxes))
    for _ in range(SPLITS):
        crowded = held(table.groupBy(*KEY).count().where(F.col("count") > crowd).select(*KEY))
        if crowded.isEmpty():
            break
        full = table.join(crowded, [*KEY], "left_semi").withColumns({"_lx": F.col("_lx") - 1, "_ly": F.col("_ly") - 1})
        table = stage(table.join(crowded, [*KEY], "left_anti").unionByName(_covering(full)))
    return table


def candidates(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (x, y) with the boxes of the polygons that share a cell with them, before any test.

    A point asks each grid in use whose boxes reach as far as it; there are as many grids as pairs of extents that differ
    by doubling, whatever the number of polygons.
    """
    table = cells(polygons)
    reach = [F.min("min_x"), F.max("max_x"), F.min("min_y"), F.max("max_y")]
    grids = [tuple(r) for r in table.groupBy("_lx", "_ly").agg(*reach).collect()]
    names = ("lx", "ly", "min_x", "max_x", "min_y", "max_y")
    kind = "array<struct<lx:int,ly:int,min_x:double,max_x:double,min_y:double,max_y:double>>"
    known = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, g)]) for g in grids]).cast(kind)
    x, y = F.col("x"), F.col("y")
    near = F.filter(known, lambda g: x.between(g["min_x"], g["max_x"]) & y.between(g["min_y"], g["max_y"]))
    asked = points.withColumn("_g", F.explode(near)).select(*points.columns, F.col("_g.lx").alias("_lx"), F.col("_g.ly").alias("_ly"))
    asked = asked.withColumns({"_cx": _cell(x, F.col("_lx")), "_cy": _cell(y, F.col("_ly"))})
    return asked.join(table, [*KEY])


def within(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (x, y) with the polygon they lie in; NULL outside all, several rows on overlap.

    Only ids and boxes meet in the cells. Outlines join the candidates whose box holds the point, by polygon id.
    """
    asked = candidates(points.select("x", "y").where("x is not null and y is not null").distinct(), polygons)
    pairs = asked.where("x between min_x and max_x and y between min_y and max_y").select("x", "y", "poly_id")
    hits = pairs.join(polygons.select("poly_id", "edges"), "poly_id").where(contains(F.col("edges"), F.col("x"), F.col("y")))
    hits = hits.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "poly_id")
    return points.join(hits, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_x", "_y")


def _reach() -> tuple[Column, Column]:
    """Least and greatest distance from a point to a bounding box."""
    x, y = F.col("x"), F.col("y")
    near = [F.greatest(F.col(f"min_{c}") - v, v - F.col(f"max_{c}"), F.lit(0.0)) for c, v in (("x", x), ("y", y))]
    far = [F.greatest(F.abs(v - F.col(f"min_{c}")), F.abs(v - F.col(f"max_{c}"))) for c, v in (("x", x), ("y", y))]
    return F.sqrt(near[0] ** 2 + near[1] ** 2), F.sqrt(far[0] ** 2 + far[1] ** 2)


def _closest(rows: DataFrame, point_id: str) -> DataFrame:
    """The boxes of each point that are no farther than the greatest distance to its best box."""
    near, far = _reach()
    bound = F.min("_far").over(W.partitionBy(point_id))
    kept = rows.withColumns({"_near": near, "_far": far}).withColumn("_bound", bound)
    return kept.where(F.col("_near") <= F.col("_bound") * (1 + 1e-12)).drop("_near", "_far", "_bound")


DEPTH, STEP = 48, 12
LEAF = 8
NODE = ("_l", "_cx", "_cy")


def tree(polygons: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """Nodes of a quadtree over the middles of the polygons' boxes, the polygons with their leaves, and its depth.

    A node has the box around all polygons below it. It has children if more than ``leaf`` polygons lie in it, so the tree
    is as deep as the polygons are dense at a place, and a leaf holds few of them unless their middles all but coincide
    (``DEPTH`` halvings of the whole). One aggregate counts the polygons in the nodes of ``STEP`` levels; only those that
    are still crowded there take part in the next ones.
    """
    edges = ("min_x", "max_x", "min_y", "max_y")
    x, y = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    low_x, high_x, low_y, high_y = polygons.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    side = max(high_x - low_x, high_y - low_y) if low_x is not None else 0.0
    most = (1 << DEPTH) - 1

    def part(c: Column, low: float | None) -> Column:
        return F.least(F.lit(most), F.floor((c - (low or 0.0)) / (side or 1.0) * (most + 1))).cast("long")

    def place(c: str, level: Column) -> Column:
        return F.call_function("shiftright", c, F.lit(DEPTH) - level)

    left = polygons.select("poly_id", *edges, part(x, low_x).alias("_px"), part(y, low_y).alias("_py"))
    nodes = leaves = None
    for start in range(0, DEPTH + 1, STEP):
        end = min(start + STEP, DEPTH + 1)
        paths = left.withColumn("_l", F.explode(F.array(*[F.lit(i) for i in range(start, end)])))
        paths = paths.withColumns({"_cx": place("_px", F.col("_l")), "_cy": place("_py", F.col("_l"))})
        counted = paths.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("_n"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
            F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
        full = counted.where(F.col("_n") > leaf).select((F.col("_l") + 1).alias("_ul"), F.col("_cx").alias("_ux"), F.col("_cy").alias("_uy"))
        up = (F.col("_l") == F.col("_ul")) & (F.shiftright("_cx", 1) == F.col("_ux")) & (F.shiftright("_cy", 1) == F.col("_uy"))
        kept = counted.join(full, up, "left").where((F.col("_l") == start) | F.col("_ul").isNotNull())
        ends = (F.col("_n") <= leaf) | (F.col("_l") == DEPTH)
        kept = held(kept.select(*NODE, *edges, ends.alias("_leaf")))
        found = stage(paths.join(kept.where("_leaf").select(*NODE), [*NODE]).select("poly_id", *edges, *NODE))
        nodes, leaves = (kept, found) if nodes is None else (nodes.unionByName(kept), leaves.unionByName(found))
        crowded = kept.where(~F.col("_leaf") & (F.col("_l") == end - 1))
        if end > DEPTH or crowded.isEmpty():
            break
        keys = crowded.select("_cx", "_cy")
        left = stage(left.withColumns({"_cx": place("_px", F.lit(end - 1)), "_cy": place("_py", F.lit(end - 1))}).join(
            keys, ["_cx", "_cy"], "left_semi").drop("_cx", "_cy"))
    return nodes, leaves, nodes.agg(F.max("_l")).first()[0] or 0


def nearest(points: DataFrame, polygons: DataFrame, point_id: str) -> DataFrame:
    """Nearest polygon and its distance for every point; ties go to the smaller id.

    All points go down the tree together, one join per level: a node is left out as soon as all of it is farther than the
    whole of another one. So a point meets a few nodes per level wherever it lies, and only the polygons whose boxes remain
    are measured by their outlines.
    """
    kind = polygons.schema["poly_id"].dataType
    placed = points.where("x is not null and y is not null").select(point_id, "x", "y")
    none = points.select(point_id, F.lit(None).cast(kind).alias("poly_id"), F.lit(None).cast("double").alias("distance"))
    nodes, leaves, depth = tree(polygons)
    edges = ("min_x", "max_x", "min_y", "max_y")
    root = nodes.where("_l = 0").collect()  # one row, or none without polygons
    if not root:
        return none
    known = (*NODE, *edges, "_leaf")
    front = placed.select("*", *[F.lit(root[0][c]).alias(c) for c in known])
    for level in range(1, depth + 1):
        below = nodes.where(F.col("_l") == level).withColumnsRenamed({c: f"_b{c}" for c in known})
        down = ~F.col("_leaf") & (F.shiftright("_b_cx", 1) == F.col("_cx")) & (F.shiftright("_b_cy", 1) == F.col("_cy"))
        joined = front.join(below, down & (F.col("_l") == level - 1), "left")  # leaves found before stay
        front = _closest(joined.select(point_id, "x", "y", *[F.coalesce(f"_b{c}", c).alias(c) for c in known]), point_id)
        if level % 4 == 0 and level < depth:
            front = stage(front)
    pairs = _closest(front.select(point_id, "x", "y", *NODE).join(leaves, [*NODE]), point_id)
    pairs = pairs.select(point_id, "x", "y", "poly_id").join(polygons.select("poly_id", "edges"), "poly_id")
    x, y, outline = F.col("x"), F.col("y"), F.col("edges")
    gap = F.when(contains(outline, x, y), F.lit(0.0)).otherwise(outline_distance(outline, x, y))
    best = pairs.groupBy(point_id).agg(F.min(F.struct(gap.alias("distance"), "poly_id")).alias("b"))
    lost = none.join(placed.select(point_id), point_id, "left_anti")  # points without coordinates keep their row
    return best.select(point_id, "b.poly_id", "b.distance").unionByName(lost)


def locate(points: DataFrame, polygons: DataFrame, point_id: str) -> DataFrame:
    """One polygon per point: the one it lies in, else the nearest (J16). Overlaps go to the smaller id."""
    inside = within(points, polygons).groupBy(point_id, "x", "y").agg(F.min("poly_id").alias("poly_id"))
    inside = stage(inside)
    near = nearest(inside.where("poly_id is null").select(point_id, "x", "y"), polygons, point_id)
    hits = inside.where("poly_id is not null").select(
        point_id, "poly_id", F.lit(0.0).alias("distance"), F.lit("within").alias("match_type"))
    return hits.unionByName(near.select(point_id, "poly_id", "distance", F.lit("nearest").alias("match_type")))


def area_centroid(polygons: DataFrame) -> DataFrame:
    """Projected planar area in square kilometres and centroid in degrees.

    The web-map projection enlarges areas away from the equator; values match tools that measure in it.
    """
    def px(lon: Column) -> Column:
        return F.radians(lon) * EARTH_RADIUS

    def py(lat: Column) -> Column:
        return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS

    # Offsets from the first vertex keep the products small.
    shifted = polygons.withColumn("_o", F.struct(px(F.col("edges")[0]["x1"]).alias("x"), py(F.col("edges")[0]["y1"]).alias("y")))

    def part(e: Column) -> Column:
        x1, x2 = px(e["x1"]) - F.col("_o.x"), px(e["x2"]) - F.col("_o.x")
        y1, y2 = py(e["y1"]) - F.col("_o.y"), py(e["y2"]) - F.col("_o.y")
        cross = x1 * y2 - x2 * y1
        return F.struct(cross.alias("c"), ((x1 + x2) * cross).alias("mx"), ((y1 + y2) * cross).alias("my"))

    parts = shifted.withColumn("_p", F.transform("edges", part))

    def total(field: str) -> Column:
        return F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + p[field])

    sums = parts.select("poly_id", "_o", total("c").alias("c"), total("mx").alias("mx"), total("my").alias("my"))
    x = F.col("_o.x") + F.col("mx") / F.nullif(3 * F.col("c"), F.lit(0.0))
    y = F.col("_o.y") + F.col("my") / F.nullif(3 * F.col("c"), F.lit(0.0))
    return sums.select(
        "poly_id", (F.abs("c") / 2 / 1e6).alias("area_sqkm"),
        F.degrees(x / EARTH_RADIUS).alias("centroid_lon"),
        F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - F.lit(math.pi / 2)).alias("centroid_lat"))
