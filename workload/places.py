"""Points and polygons derived from customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import spatial as sp
from hearthstat.plans import geography
from workload.base import query, table

# Nation n is a triangle in its cell of a 5 x 5 grid of degrees; every third one has a square hole.
POLY_SQL = """
poly AS (SELECT n_nationkey AS poly_id, (n_nationkey % 5)::DOUBLE AS gx, (n_nationkey // 5)::DOUBLE AS gy FROM nation),
vert AS (
  SELECT poly_id, 0 AS ring, seq, gx + dx AS x, gy + dy AS y FROM poly, (VALUES (0, 0.1, 0.1), (1, 0.9, 0.2), (2, 0.4, 0.95)) v(seq, dx, dy)
  UNION ALL
  SELECT poly_id, 1, seq, gx + dx, gy + dy FROM poly, (VALUES (0, 0.4, 0.3), (1, 0.4, 0.5), (2, 0.5, 0.5), (3, 0.5, 0.3)) v(seq, dx, dy)
  WHERE poly_id % 3 = 0),
edge AS (
  SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vert WINDOW w AS (PARTITION BY poly_id, ring ORDER BY seq)),
pts AS (SELECT c_custkey AS point_id, ((c_custkey * 7919 + 13) % 10007) / 10007.0 * 7 - 1 AS x,
               ((c_custkey * 104729 + 7) % 10009) / 10009.0 * 7 - 1 AS y FROM customer),
ins AS (
  SELECT point_id, poly_id FROM pts JOIN edge ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
  GROUP BY ALL HAVING count(*) % 2 = 1)"""


def vertices(spark, folder):
    key = F.col("n_nationkey")
    gx, gy = (key % 5).cast("double"), F.floor(key / 5).cast("double")

    def corners(ring, points):
        return [F.struct(F.lit(ring).alias("ring"), F.lit(i).alias("seq"), (gx + dx).alias("x"), (gy + dy).alias("y"))
                for i, (dx, dy) in enumerate(points)]

    outer = corners(0, [(0.1, 0.1), (0.9, 0.2), (0.4, 0.95)])
    hole = corners(1, [(0.4, 0.3), (0.4, 0.5), (0.5, 0.5), (0.5, 0.3)])
    rows = F.when(key % 3 == 0, F.array(*outer, *hole)).otherwise(F.array(*outer))
    return table(spark, folder, "nation").select(key.alias("poly_id"), F.inline(rows))


def points(spark, folder):
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("point_id"), ((key * 7919 + 13) % 10007 / 10007.0 * 7 - 1).cast("double").alias("x"),
        ((key * 104729 + 7) % 10009 / 10009.0 * 7 - 1).cast("double").alias("y"))


@query("spatial_within", "point_id:i poly_id:i", "WITH" + POLY_SQL + """---
       SELECT point_id, poly_id FROM pts LEFT JOIN ins USING (point_id)""")
def spatial_within(spark, folder):
    return sp.within(points(spark, folder), sp.shapes(vertices(spark, folder))).select("point_id", "poly_id")


@query("spatial_nearest", "point_id:i poly_id:i distance:d match_type:s", "WITH" + POLY_SQL + """,
       far AS (SELECT * FROM pts ANTI JOIN ins USING (point_id)),
       tt AS (SELECT point_id, poly_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy,
                     least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) AS t
              FROM far CROSS JOIN edge),
       d AS (SELECT point_id, poly_id, min(sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)) AS distance FROM tt GROUP BY ALL)---
       SELECT point_id, poly_id, 0.0 AS distance, 'within' AS match_type FROM ins
       UNION ALL SELECT point_id, arg_min(poly_id, distance), min(distance), 'nearest' FROM d GROUP BY point_id""")
def spatial_nearest(spark, folder):
    return sp.locate(points(spark, folder), sp.shapes(vertices(spark, folder)), "point_id")


@query("polygon_area_centroid", "poly_id:i area_sqkm:d centroid_lon:d centroid_lat:d points:i", "WITH" + POLY_SQL + """,
       m AS (SELECT poly_id, radians(x1) * 6378137.0 AS x1, ln(tan(pi() / 4 + radians(y1) / 2)) * 6378137.0 AS y1,
                    radians(x2) * 6378137.0 AS x2, ln(tan(pi() / 4 + radians(y2) / 2)) * 6378137.0 AS y2 FROM edge),
       o AS (SELECT poly_id, min(x1) AS ox, min(y1) AS oy FROM m GROUP BY 1),
       k AS (SELECT poly_id, ox, oy, sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) AS c,
                    sum((x1 + x2 - 2 * ox) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) AS mx,
                    sum((y1 + y2 - 2 * oy) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) AS my
             FROM m JOIN o USING (poly_id) GROUP BY ALL)---
       SELECT k.poly_id, abs(c) / 2 / 1e6 AS area_sqkm, degrees((ox + mx / (3 * c)) / 6378137.0) AS centroid_lon,
              degrees(2 * atan(exp((oy + my / (3 * c)) / 6378137.0)) - pi() / 2) AS centroid_lat, coalesce(n, 0) AS points
       FROM k LEFT JOIN (SELECT poly_id, count(*) AS n FROM ins GROUP BY 1) i ON i.poly_id = k.poly_id""")
def polygon_area_centroid(spark, folder):
    shapes = sp.shapes(vertices(spark, folder))
    inside = sp.within(points(spark, folder), shapes).groupBy("poly_id").agg(F.count(F.lit(1)).alias("points"))
    return sp.area_centroid(shapes).join(inside, "poly_id", "left").na.fill(0, ["points"])


# Tracts are small triangles at places derived from suppliers, places the nations' triangles, zips bands of the regions.

TRACT_CORNERS = [(0.0, 0.0), (0.06, 0.02), (0.02, 0.08)]

LOOKUP_SQL = POLY_SQL + """,
tv AS (SELECT s_suppkey AS k, seq, ((s_suppkey * 7919 + 13) % 10007) / 10007.0 * 6 - 0.5 + dx AS x,
              ((s_suppkey * 104729 + 7) % 10009) / 10009.0 * 6 - 0.5 + dy AS y
       FROM supplier, (VALUES (0, 0.0, 0.0), (1, 0.06, 0.02), (2, 0.02, 0.08)) v(seq, dx, dy)),
tm AS (SELECT k, seq, radians(x) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0 AS y FROM tv),
te AS (SELECT k, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2,
              first_value(x) OVER w AS ox, first_value(y) OVER w AS oy FROM tm WINDOW w AS (PARTITION BY k ORDER BY seq)),
tk AS (SELECT k, ox, oy, sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) AS c,
              sum((x1 + x2 - 2 * ox) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) AS mx,
              sum((y1 + y2 - 2 * oy) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) AS my FROM te GROUP BY ALL),
tp AS (SELECT k AS point_id, abs(c) / 2 / 1e6 AS area_sqkm, degrees((ox + mx / (3 * c)) / 6378137.0) AS x,
              degrees(2 * atan(exp((oy + my / (3 * c)) / 6378137.0)) - pi() / 2) AS y FROM tk),
th AS (SELECT point_id, poly_id FROM tp JOIN edge ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
       GROUP BY ALL HAVING count(*) % 2 = 1),
tt AS (SELECT point_id, poly_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy,
              least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) AS t
       FROM tp ANTI JOIN th USING (point_id), edge),
td AS (SELECT point_id, poly_id, min(sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)) AS distance FROM tt GROUP BY ALL),
place AS (SELECT point_id, min(poly_id) AS poly_id FROM th GROUP BY 1 UNION ALL SELECT point_id, arg_min(poly_id, distance) FROM td GROUP BY 1),
f AS (SELECT s_suppkey AS k, s_suppkey % 60 AS a18, s_suppkey % 90 AS renter, s_suppkey % 25 AS a65, s_suppkey % 12 AS alone, s_suppkey * 3 % 70 AS family,
             s_suppkey % 33 AS kids, s_suppkey * 7 % 40 AS poverty, s_suppkey * 11 % 50 AS low FROM supplier WHERE s_suppkey % 11 <> 0),
g AS (SELECT s.s_suppkey AS k, s_name, area_sqkm, x, y, n_name,
             CASE WHEN x BETWEEN -10 AND 10 AND y >= 0 AND y < 5 THEN 'Z' || floor(y)::INT END AS primary_zip, f.* EXCLUDE (k)
      FROM supplier s JOIN tp ON point_id = s_suppkey JOIN place USING (point_id) JOIN nation ON n_nationkey = poly_id LEFT JOIN f ON f.k = s_suppkey),
t AS (SELECT *, CASE WHEN a18 >= 40 AND renter >= 70 THEN 'Student-dense area'
                     WHEN a65 >= 18 AND alone >= 10 THEN 'Senior-heavy residential area'
                     WHEN family >= 55 AND kids >= 25 THEN 'Family-oriented residential area'
                     WHEN poverty >= 25 AND low >= 30 THEN 'Higher economic stress area' ELSE 'Mixed residential area' END AS area_type,
             array_to_string(list_filter([CASE WHEN a18 >= 40 THEN 'higher student concentration' END,
                CASE WHEN renter >= 65 THEN 'renter-heavy housing profile' END, CASE WHEN poverty >= 25 THEN 'higher poverty rate' END,
                CASE WHEN low >= 30 THEN 'more very-low-income households' END, CASE WHEN kids >= 25 THEN 'more households with children' END,
                CASE WHEN a65 >= 18 THEN 'older age profile' END], lambda p: p IS NOT NULL), '; ') AS note FROM g)"""


@query("geography_lookup", "tract_geoid:s area_sqkm:d centroid_lon:d centroid_lat:d primary_place:s primary_zip:s area_type:s "
       "landmark_context_note:s display_area_label:s", "WITH" + LOOKUP_SQL + """---
       SELECT k::VARCHAR AS tract_geoid, area_sqkm, x AS centroid_lon, y AS centroid_lat, n_name AS primary_place, primary_zip, area_type,
              CASE WHEN note = '' THEN 'General tract context note not flagged by the current rule set.'
                   ELSE upper(note[1]) || lower(note[2:]) || '.' END AS landmark_context_note, n_name || ' — ' || area_type AS display_area_label FROM t""")
def geography_lookup(spark, folder):
    key = F.col("s_suppkey")
    x, y = (key * 7919 + 13) % 10007 / 10007.0 * 6 - 0.5, (key * 104729 + 7) % 10009 / 10009.0 * 6 - 0.5
    corners = [F.struct(F.lit(0).alias("ring"), F.lit(i).alias("seq"), (x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
               for i, (dx, dy) in enumerate(TRACT_CORNERS)]
    suppliers = table(spark, folder, "supplier")
    tracts = suppliers.select(key.cast("string").alias("poly_id"), F.inline(F.array(*corners)))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("poly_id"), F.concat("n_name", F.lit(" city")).alias("name"))
    places = vertices(spark, folder).join(names, "poly_id").select(F.col("name").alias("poly_id"), "ring", "seq", "x", "y")
    band = F.col("r_regionkey").cast("double")
    sides = [F.struct(F.lit(0).alias("ring"), F.lit(i).alias("seq"), F.lit(a).alias("x"), (band + b).alias("y"))
             for i, (a, b) in enumerate([(-10.0, 0.0), (10.0, 0.0), (10.0, 1.0), (-10.0, 1.0)])]
    zips = table(spark, folder, "region").select(F.concat(F.lit("Z"), "r_regionkey").alias("poly_id"), F.inline(F.array(*sides)))
    context = suppliers.where(key % 11 != 0).select(
        key.cast("string").alias("tract_geoid"), (key % 60).alias("pct_age_18_24"), (key % 90).alias("pct_renter_occupied"),
        (key % 25).alias("pct_age_65_plus"), (key % 12).alias("pct_senior_living_alone_households"), (key * 3 % 70).alias("pct_family_households"),
        (key % 33).alias("pct_households_with_own_children_under_18"), (key * 7 % 40).alias("poverty_rate"), (key * 11 % 50).alias("pct_hh_income_under_25k"))
    dimension = suppliers.select(key.cast("string").alias("tract_geoid"), F.col("s_name").alias("tract_name_canonical"))
    found = geography.geography_lookup(dimension, context, tracts, places, zips)
    return found.select("tract_geoid", "area_sqkm", "centroid_lon", "centroid_lat", "primary_place", "primary_zip", "area_type",
                        "landmark_context_note", "display_area_label")
