"""Queries over terrain, airports, points and second sources, and their SQL.

All run over whole tables. Terrain is a grid of 48 x 48 quads of 120 m over every
patch that has orders; each order lifts one of its corners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions import geo, rings
from terralith.operators import elements as el
from terralith.operators import footprints as fo
from terralith.operators import places, terrain
from terralith.plans.derived import FOOTPRINTS_SQL, ML_SQL, footprints, patch_name, table
from terralith.sources import readers

Q: dict = {}
O: dict = {}  # noqa: E741

QUADS, CELL_M = 48, 120.0

TERRAIN_SQL = f"""
oc AS (SELECT printf('%03d%03d', (o_custkey % 25) % 5, (o_custkey % 25) // 5) AS patch_id, o_orderkey AS k FROM orders),
bump AS (SELECT patch_id, (k * 31) % {QUADS + 1} AS i, (k * 57) % {QUADS + 1} AS j, count(*) AS n FROM oc GROUP BY ALL),
corner AS (
  SELECT patch_id, i, j, 100 + ((i * 37 + j * 91) % 50) / 10::DOUBLE + coalesce(n, 0) / 10::DOUBLE AS z
  FROM (SELECT * FROM (SELECT DISTINCT patch_id FROM oc), range({QUADS + 1}) a(i), range({QUADS + 1}) b(j)) LEFT JOIN bump USING (patch_id, i, j)
),
qd AS MATERIALIZED (
  SELECT a.patch_id, a.i, a.j, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM corner a
  JOIN corner b ON b.patch_id = a.patch_id AND b.i = a.i + 1 AND b.j = a.j
  JOIN corner c ON c.patch_id = a.patch_id AND c.i = a.i + 1 AND c.j = a.j + 1
  JOIN corner d ON d.patch_id = a.patch_id AND d.i = a.i AND d.j = a.j + 1
)"""


def elevation_sql(source: str, name: str) -> str:
    """CTE ``name``: rows of ``source`` (patch_id, px, py) with z, that of the first triangle there; null outside."""
    return f"""
{name}0 AS (
  SELECT *, least({QUADS - 1}, greatest(0, ceil(round((px + 2880) / {CELL_M}, 9)) - 1))::BIGINT AS ci, least({QUADS - 1}, greatest(0, ceil(round((py + 2880) / {CELL_M}, 9)) - 1))::BIGINT AS cj FROM {source}
),
{name}1 AS (SELECT s.*, za, zb, zc, zd, (px + 2880) / {CELL_M} - ci AS fx, (py + 2880) / {CELL_M} - cj AS fy FROM {name}0 s LEFT JOIN qd ON qd.patch_id = s.patch_id AND qd.i = ci AND qd.j = cj),
{name} AS (
  SELECT *, CASE WHEN px BETWEEN -2880 AND 2880 AND py BETWEEN -2880 AND 2880 THEN
    CASE WHEN fx >= fy - 1e-11 THEN za + (zb - za) * fx + (zc - zb) * fy ELSE za + (zc - zd) * fx + (zd - za) * fy END END AS z FROM {name}1
)"""


def triangles(spark, sf) -> DataFrame:
    """(patch_id, tri, x1 .. z3): two triangles a quad."""
    k, n = F.col("k"), QUADS + 1
    orders = table(spark, sf, "orders").select(patch_name(F.col("o_custkey") % 25).alias("patch_id"), F.col("o_orderkey").alias("k"))
    bumps = orders.groupBy("patch_id", (k * 31 % n).alias("i"), (k * 57 % n).alias("j")).agg(F.count("*").alias("n"))
    along = lambda name: F.explode(F.sequence(F.lit(0), F.lit(QUADS))).alias(name)
    grid = orders.select("patch_id").distinct().select("patch_id", along("i")).select("patch_id", "i", along("j"))
    z = F.lit(100.0) + (F.col("i") * 37 + F.col("j") * 91) % 50 / 10.0 + F.coalesce("n", F.lit(0)) / 10.0
    corner = grid.join(bumps, ["patch_id", "i", "j"], "left").select("patch_id", "i", "j", z.alias("z"))
    # Each corner belongs to up to four quads.
    sides = F.array(*[F.struct((F.col("i") - di).alias("qi"), (F.col("j") - dj).alias("qj"), F.lit(name).alias("corner")) for name, di, dj in (("a", 0, 0), ("b", 1, 0), ("c", 1, 1), ("d", 0, 1))])
    each = corner.select("patch_id", "z", F.inline(sides)).where(F.col("qi").between(0, QUADS - 1) & F.col("qj").between(0, QUADS - 1))
    quad = each.groupBy("patch_id", "qi", "qj").agg(*[F.max(F.when(F.col("corner") == c, F.col("z"))).alias(c) for c in "abcd"])
    x, y = F.col("qi") * CELL_M - 2880, F.col("qj") * CELL_M - 2880
    at = {"a": (x, y), "b": (x + CELL_M, y), "c": (x + CELL_M, y + CELL_M), "d": (x, y + CELL_M)}
    number = (F.col("qi") * QUADS + F.col("qj")) * 2
    half = lambda h, names: F.struct((number + h).alias("tri"), *[v.alias(f"{axis}{p}") for p, c in enumerate(names, 1) for axis, v in zip("xyz", (*at[c], F.col(c)))])
    return quad.select("patch_id", F.inline(F.array(half(0, "abc"), half(1, "acd"))))


def add(name: str, query, sql: str) -> None:
    Q[name] = query
    O[name] = f"WITH {sql.strip()}"


r3 = lambda c: F.round(c, 3) + F.lit(0.0)
r4 = lambda c: F.round(c, 4) + F.lit(0.0)


# Terrain


def a20_terrain_statistics(spark, sf):
    return terrain.statistics(triangles(spark, sf)).select("*", r4(F.col("z_min")).alias("low"), r4(F.col("z_max")).alias("high")).drop("z_min", "z_max")


add("a20_terrain_statistics", a20_terrain_statistics, TERRAIN_SQL + """
SELECT patch_id, 2 * count(*) AS triangles, 5760::DOUBLE AS x_extent, 5760::DOUBLE AS y_extent, 0::BIGINT AS short_edges, FALSE AS suspicious,
  round(min(least(za, zb, zc, zd)), 4) AS low, round(max(greatest(za, zb, zc, zd)), 4) AS high
FROM qd GROUP BY patch_id""")


def supports(spark, sf) -> DataFrame:
    """Chimneys, masts and turbines: a supplier each, in all patches and up to 120 m beyond their borders."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        patch_name(k % 25).alias("patch_id"), F.concat(F.lit("p"), k.cast("string")).alias("point_id"), ((k * 7919) % 6000 - 3000).cast("double").alias("px"),
            ((k * 104729) % 6000 - 3000).cast("double").alias("py"),
        F.when(k % 3 == 0, "chimney").when(k % 3 == 1, "mast").otherwise("turbine").alias("kind"), F.when(k % 4 != 0, (k % 120).cast("double")).alias("height"), F
            .when(k % 5 == 0, "brick").alias("material"),
    )


POINTS_SQL = """
pt AS (
  SELECT printf('%03d%03d', (s_suppkey % 25) % 5, (s_suppkey % 25) // 5) AS patch_id, 'p' || s_suppkey AS point_id, s_suppkey AS k,
    (s_suppkey * 7919) % 6000 - 3000.0::DOUBLE AS px, (s_suppkey * 104729) % 6000 - 3000.0::DOUBLE AS py,
    CASE s_suppkey % 3 WHEN 0 THEN 'chimney' WHEN 1 THEN 'mast' ELSE 'turbine' END AS kind, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 120)::DOUBLE END AS height,
      CASE WHEN s_suppkey % 5 = 0 THEN 'brick' END AS material
  FROM supplier
)"""


def j7_elevations(spark, sf):
    return terrain.elevations(supports(spark, sf), triangles(spark, sf), ["patch_id", "point_id", "px", "py"], CELL_M).select("point_id", r4(F.col("z")).alias("z"))


add("j7_elevations", j7_elevations, f"{POINTS_SQL},{TERRAIN_SQL},{elevation_sql('pt', 'zz')} SELECT point_id, round(z, 4) + 0 AS z FROM zz WHERE z IS NOT NULL")

_CROSSINGS = "sum(CASE WHEN ring_no = {ring} AND ((y > py) <> (y2 > py)) AND px < (x2 - x) * (py - y) / (y2 - y) + x THEN 1 ELSE 0 END) % 2"
_IN_AREA = f"{_CROSSINGS.format(ring=0)} = 1 AND {_CROSSINGS.format(ring=1)} = 0"
SAMPLES_SQL = FOOTPRINTS_SQL + f"""
, bb AS (SELECT patch_id, osm_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my FROM rv WHERE ring_no = 0 GROUP BY ALL),
gp AS (SELECT osm_id, x0 + 5.0 * i AS px, y0 + 5.0 * unnest(generate_series(0, floor((y1 - y0) / 5 + 1e-9)::INT)) AS py FROM (SELECT *, unnest(generate_series(0, floor((x1 - x0) / 5 + 1e-9)::INT)) AS i FROM bb)),
ins AS (SELECT g.osm_id, px, py FROM gp g JOIN edges e USING (osm_id) GROUP BY ALL HAVING {_IN_AREA}),
lad AS (SELECT osm_id, unnest([x0, x1, x1, x0, (x0 + x1) / 2]) AS px, unnest([y0, y0, y1, y1, (y0 + y1) / 2]) AS py FROM bb WHERE osm_id NOT IN (SELECT osm_id FROM ins)),
lin AS (SELECT g.osm_id, px, py FROM lad g JOIN edges e USING (osm_id) GROUP BY ALL HAVING {_IN_AREA}),
smp AS (SELECT patch_id, s.* FROM (FROM ins UNION ALL FROM lin) s JOIN bb USING (osm_id))
"""


def j8_sample_grid(spark, sf):
    return terrain.sample_grid(footprints(spark, sf)).groupBy("osm_id").agg(F.count("*").alias("samples"), r3(F.sum("px")).alias("sum_x"), r3(F.sum("py")).alias("sum_y"))


add("j8_sample_grid", j8_sample_grid, SAMPLES_SQL + "SELECT osm_id, count(*) AS samples, round(sum(px), 3) + 0 AS sum_x, round(sum(py), 3) + 0 AS sum_y FROM smp GROUP BY osm_id")


def j9_a10_floors(spark, sf):
    found = terrain.floors(footprints(spark, sf), triangles(spark, sf), size=CELL_M)
    return found.select("osm_id", *[r4(F.col(c)).alias(c) for c in ("floor_z", "min_z", "max_z")], "samples")


add("j9_a10_floors", j9_a10_floors, f"""{SAMPLES_SQL}, {TERRAIN_SQL}, {elevation_sql('smp', 'zz')},
kn AS (SELECT osm_id, min(z) AS lo, max(z) AS hi, count(z) AS n FROM zz WHERE z IS NOT NULL GROUP BY osm_id),
md AS (SELECT patch_id, osm_id, mx AS px, my AS py FROM bb WHERE osm_id NOT IN (SELECT osm_id FROM kn)), {elevation_sql('md', 'yy')}
SELECT bb.osm_id, round(coalesce(coalesce(lo, z) - 0.3, 0), 4) + 0 AS floor_z, round(coalesce(lo, z, 0), 4) + 0 AS min_z, round(coalesce(hi, z, 0), 4) + 0 AS max_z, coalesce(n, 0) AS samples
FROM bb LEFT JOIN kn USING (osm_id) LEFT JOIN yy USING (osm_id)""")


def j10_feet(spark, sf):
    return terrain.feet(supports(spark, sf), triangles(spark, sf), ["patch_id", "point_id"], size=CELL_M).select("point_id", r4(F.col("foot_z")).alias("foot_z"))


add("j10_feet", j10_feet, f"""{POINTS_SQL}, {TERRAIN_SQL},
fv AS (SELECT patch_id, point_id, greatest(-2879, least(2879, px + unnest([0, 4, -4, 0, 0]))) AS px, greatest(-2879, least(2879, py + unnest([0, 0, 0, 4, -4]))) AS py FROM pt), {elevation_sql('fv', 'zz')}
SELECT point_id, round(coalesce(min(z) - 0.3, 0), 4) + 0 AS foot_z FROM zz GROUP BY point_id""")


def j11_neighbour_elevations(spark, sf):
    return terrain.surface(supports(spark, sf), triangles(spark, sf), ["point_id"], CELL_M).select("point_id", r4(F.col("z")).alias("z"))


add("j11_neighbour_elevations", j11_neighbour_elevations, f"""{POINTS_SQL}, {TERRAIN_SQL},
sd AS (SELECT *, CASE WHEN px > 2880 THEN 1 WHEN px < -2880 THEN -1 ELSE 0 END AS dx, CASE WHEN py > 2880 THEN 1 WHEN py < -2880 THEN -1 ELSE 0 END AS dy FROM pt),
mv AS (SELECT point_id, patch_id AS home_id, printf('%03d%03d', left(patch_id, 3)::INT + dx, right(patch_id, 3)::INT + dy) AS patch_id, px - dx * 5760 AS px, py - dy * 5760 AS py FROM sd), {elevation_sql('mv', 'zz')},
lo AS (SELECT patch_id AS home_id, min(least(za, zb, zc, zd)) AS lowest FROM qd GROUP BY patch_id)
SELECT point_id, round(coalesce(z, lowest), 4) + 0 AS z FROM zz LEFT JOIN lo USING (home_id)""")


def j11_neighbour_points(spark, sf):
    return terrain.neighbour_points(supports(spark, sf)).select("point_id", "home_id", "patch_id", "px", "py")


add("j11_neighbour_points", j11_neighbour_points, f"""{POINTS_SQL},
sd AS (SELECT *, CASE WHEN px > 2880 THEN 1 WHEN px < -2880 THEN -1 ELSE 0 END AS dx, CASE WHEN py > 2880 THEN 1 WHEN py < -2880 THEN -1 ELSE 0 END AS dy FROM pt)
SELECT point_id, patch_id AS home_id, printf('%03d%03d', left(patch_id, 3)::INT + dx, right(patch_id, 3)::INT + dy) AS patch_id, px - dx * 5760 AS px, py - dy * 5760 AS py FROM sd""")


# Points


def p26_g11_point_models(spark, sf):
    models = supports(spark, sf).where("kind <> 'turbine'").withColumn("m", places.point_model(F.col("kind"), F.col("height"), F.col("material")))
    return models.select("point_id", "m.model", F.round("m.scale", 6).alias("scale"))


add("p26_g11_point_models", p26_g11_point_models, f"""{POINTS_SQL},
h AS (SELECT *, coalesce(height, 30) AS m, coalesce(material, '') <> 'brick' AND coalesce(height, 30) > 30 AS big FROM pt WHERE kind <> 'turbine')
SELECT point_id, CASE WHEN kind = 'chimney' THEN CASE WHEN big THEN 'chimney_big' ELSE 'chimney_small' END WHEN m > 100 THEN 'transmitter_big' ELSE 'transmitter_small' END AS model,
  round(m / CASE WHEN kind = 'chimney' THEN CASE WHEN big THEN 100 ELSE 30 END WHEN m > 100 THEN 200 ELSE 50 END, 6) AS scale FROM h""")


def f5_point_kinds(spark, sf):
    """Tags of seven kinds, one an event, and which predicates hold."""
    e = F.col("event_id")
    as_map = lambda *pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    kinds = [
        (0, as_map(("man_made", "chimney"))), (1, as_map(("man_made", "mast"), ("communication:radio", "yes"))), (2, as_map(("power", "generator"), ("generator:source", "wind"))),
        (3, as_map(("power", "generator"), ("generator:source", "solar"))), (4, as_map(("aeroway", "aerodrome"))), (5, as_map(("aeroway", "runway"), ("abandoned:aeroway", "runway"))),
    ]
    tags = F.coalesce(*[F.when(e % 7 == k, m) for k, m in kinds], F.create_map().cast("map<string,string>"))
    own = table(spark, sf, "events").select((e % 7).alias("kind"), tags.alias("tags"))
    tests = {"chimney": el.is_chimney, "transmitter": el.is_transmitter, "turbine": el.is_wind_turbine, "aerodrome": el.is_aerodrome, "runway": el.is_runway, "disused": el.is_disused}
    return own.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(test(F.col("tags"))).alias(name) for name, test in tests.items()])


add("f5_point_kinds", f5_point_kinds, """
e AS (SELECT event_id % 7 AS kind, count(*) AS n FROM events GROUP BY ALL)
SELECT kind, n, CASE WHEN kind = 0 THEN n ELSE 0 END AS chimney, CASE WHEN kind = 1 THEN n ELSE 0 END AS transmitter, CASE WHEN kind = 2 THEN n ELSE 0 END AS turbine,
  CASE WHEN kind = 4 THEN n ELSE 0 END AS aerodrome,
  CASE WHEN kind = 5 THEN n ELSE 0 END AS runway, CASE WHEN kind = 5 THEN n ELSE 0 END AS disused FROM e""")


def ways(spark, sf, times: float = 1.0) -> DataFrame:
    """Footprints as ways, ``times`` as large about the mean of their corners."""
    own = footprints(spark, sf).select("patch_id", F.col("osm_id").alias("way_id"), F.col("k").alias("nth"), F.col("outer").alias("ring"))
    if times == 1.0:
        return own
    mid = fo.computed(own, {"mid": rings.vertex_mean(F.col("ring"))})
    wide = F.transform("ring", lambda p: F.struct((F.col("mid.x") + (p["x"] - F.col("mid.x")) * times).alias("x"), (F.col("mid.y") + (p["y"] - F.col("mid.y")) * times).alias("y")))
    return mid.withColumn("ring", wide).drop("mid")


def j13_quiet_ways(spark, sf):
    return places.quiet_ways(ways(spark, sf), _points(spark, sf)).select("way_id")


def j13_dense_ways(spark, sf):
    """Ways eleven times as long and wide, so that many lie around others' centres and chains of them form."""
    return places.quiet_ways(ways(spark, sf, DENSE), _points(spark, sf), 100.0).select("way_id")


DENSE = 11.0


def _points(spark, sf) -> DataFrame:
    return supports(spark, sf).select("patch_id", F.col("px").alias("x"), F.col("py").alias("y"))


_TURNS = (
    "sum(CASE WHEN y <= {py} AND y2 > {py} AND (x2 - x) * ({py} - y) - ({px} - x) * (y2 - y) > 0 THEN 1 WHEN y > {py} AND y2 <= {py} "
    "AND (x2 - x) * ({py} - y) - ({px} - x) * (y2 - y) < 0 THEN -1 ELSE 0 END) <> 0"
)


def quiet_sql(times: float) -> str:
    """The rounds of settled ways as a recursion over one row, whose lists hold the open conflicts and the ways turned down."""
    wide = lambda c, m: f"m{m} + ({c} - m{m}) * {times}::DOUBLE" if times != 1 else c
    return f"""RECURSIVE {FOOTPRINTS_SQL}, {POINTS_SQL},
mid AS (SELECT osm_id, avg(x) AS mx, avg(y) AS my FROM rv WHERE ring_no = 0 GROUP BY osm_id),
we AS (SELECT patch_id, osm_id, pos, {wide('x', 'x')} AS x, {wide('y', 'y')} AS y, {wide('x2', 'x')} AS x2, {wide('y2', 'y')} AS y2 FROM edges JOIN mid USING (osm_id) WHERE ring_no = 0),
ct AS (SELECT patch_id, osm_id, osm_id::BIGINT AS k, (sum(x) + max(x) FILTER (pos = 0)) / (count(*) + 1) AS cx, (sum(y) + max(y) FILTER (pos = 0)) / (count(*) + 1) AS cy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM we GROUP BY patch_id, osm_id),
h1 AS (
  SELECT e.osm_id FROM ct JOIN pt ON ct.patch_id = pt.patch_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 JOIN we e ON e.osm_id = ct.osm_id
  GROUP BY e.osm_id, point_id, px, py HAVING {_TURNS.format(px='px', py='py')}
),
fr AS (SELECT * FROM ct WHERE osm_id NOT IN (SELECT osm_id FROM h1)),
cf AS (
  SELECT c.k AS a, fr.k AS b FROM fr JOIN fr c ON c.patch_id = fr.patch_id AND c.k < fr.k AND c.cx BETWEEN fr.x0 AND fr.x1 AND c.cy BETWEEN fr.y0 AND fr.y1 JOIN we e ON e.osm_id = fr.osm_id
  GROUP BY fr.k, c.k, c.cx, c.cy HAVING {_TURNS.format(px='c.cx', py='c.cy')}
),
st AS (
  SELECT 0 AS nth, coalesce(list({{'a': a, 'b': b}}), []) AS es, []::BIGINT[] AS gone FROM cf
  UNION ALL
  SELECT nth + 1, list_filter(es, lambda e: NOT list_contains(now, e.a) AND NOT list_contains(now, e.b) AND NOT list_contains(free, e.a)), list_concat(gone, now)
  FROM (SELECT *, list_distinct(list_transform(list_filter(es, lambda e: list_contains(free, e.a)), lambda e: e.b)) AS now
    FROM (SELECT nth, es, gone, list_filter(list_distinct(list_transform(es, lambda e: e.a)), lambda n: NOT list_contains(later, n)) AS free
      FROM (SELECT *, list_distinct(list_transform(es, lambda e: e.b)) AS later FROM st WHERE len(es) > 0)))
)
SELECT osm_id AS way_id FROM fr WHERE NOT list_contains((SELECT gone FROM st ORDER BY nth DESC LIMIT 1), k)"""


add("j13_quiet_ways", j13_quiet_ways, quiet_sql(1.0))
add("j13_dense_ways", j13_dense_ways, quiet_sql(DENSE))


# Airports


AIRPORT_SQL = """
ap AS (
  SELECT c_custkey AS id, c_mktsegment || c_nationkey AS name, 600.0::DOUBLE + (c_custkey % 30) * 100 AS length_m, CASE c_custkey % 3 WHEN 0 THEN 'aerodrome'
    WHEN 1 THEN 'runway_disused' ELSE 'runway' END AS source,
    CASE c_custkey % 3 WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rk, 40 + (c_custkey % 1000) / 100.0::DOUBLE AS lat, 12 + (c_custkey % 600) / 100.0::DOUBLE AS lon,
    printf('%03d%03d', (c_custkey % 25) % 5, (c_custkey % 25) // 5) AS patch_id
  FROM customer
)"""


def airports(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), (F.lit(600.0) + k % 30 * 100).alias("length_m"), F
            .when(k % 3 == 0, "aerodrome").when(k % 3 == 1, "runway_disused").otherwise("runway").alias("source"),
        (F.lit(40.0) + k % 1000 / 100.0).alias("lat"), (F.lit(12.0) + k % 600 / 100.0).alias("lon"), patch_name(k % 25).alias("patch_id"),
    )


def r2_upsert_airports(spark, sf):
    """A fifth of the airports are the registry, the others were found."""
    longest = lambda rows: rows.groupBy("name", "source").agg(F.max("length_m").alias("length_m"))
    every = airports(spark, sf)
    return places.upsert_airports(longest(every.where("id % 5 = 0")), longest(every.where("id % 5 <> 0"))).select("name", "source", "length_m")


add("r2_upsert_airports", r2_upsert_airports, AIRPORT_SQL + """,
u AS (SELECT name, source, rk, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS known, max(length_m) AS length_m FROM ap GROUP BY ALL)
SELECT name, source, length_m FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY rk DESC, known, length_m DESC) = 1""")


def a22_p29_longest_runways(spark, sf):
    return places.longest_runways(airports(spark, sf)).select("name", "length_m", "source")


add("a22_p29_longest_runways", a22_p29_longest_runways, AIRPORT_SQL + """
SELECT name, CASE WHEN source = 'aerodrome' THEN 1500 ELSE length_m END::DOUBLE AS length_m, source FROM ap WHERE length_m >= 50
QUALIFY row_number() OVER (PARTITION BY name ORDER BY source = 'aerodrome', source <> 'runway', length_m DESC) = 1""")


def p29_runway_length(spark, sf):
    """A quarter of the runways is tagged in metres, another with what is no number."""
    k = F.col("id")
    tag = F.when(k % 4 == 0, F.concat((k % 2000).cast("string"), F.lit(" M"))).when(k % 4 == 1, "long")
    metres = places.runway_length(tag, F.col("lat"), F.col("lon"), F.col("lat") + k % 30 / 1000.0, F.col("lon") + k % 20 / 1000.0)
    return airports(spark, sf).select("id", r3(metres).alias("metres")).withColumn("usable", F.col("metres") >= places.SHORTEST_M)


add("p29_runway_length", p29_runway_length, AIRPORT_SQL + """,
ln AS (SELECT id, CASE
  WHEN id % 4 = 0 THEN (id % 2000)::DOUBLE ELSE sqrt((id % 20 / 1000.0::DOUBLE * 111320.0::DOUBLE * cos(radians((lat + lat + id % 30 / 1000.0::DOUBLE) / 2))) ** 2 + (id % 30 / 1000.0::DOUBLE * 111320.0::DOUBLE) ** 2) END AS m
  FROM ap)
SELECT id, round(m, 3) + 0 AS metres, round(m, 3) >= 50 AS usable FROM ln""")


def zones(spark, sf) -> DataFrame:
    """Zones of all airports, in the frames of their patches."""
    k = F.col("id")
    at = {"zx": ((k * 7919) % 5760 - 2880).cast("double"), "zy": ((k * 104729) % 5760 - 2880).cast("double")}
    return places.airport_zones(airports(spark, sf)).select("id", "patch_id", *[c.alias(n) for n, c in at.items()], "zone_m")


ZONES_SQL = AIRPORT_SQL + ", zn AS (SELECT id, patch_id, (id * 7919) % 5760 - 2880.0::DOUBLE AS zx, (id * 104729) % 5760 - 2880.0::DOUBLE AS zy, length_m / 2 + 458 AS zone_m FROM ap)"


def s6_airport_zones(spark, sf):
    return zones(spark, sf).select("id", "zone_m")


add("s6_airport_zones", s6_airport_zones, ZONES_SQL + " SELECT id, zone_m FROM zn")


def j14_spans_in_zones(spark, sf):
    middles = supports(spark, sf).select("patch_id", "point_id", F.col("px").alias("mx"), F.col("py").alias("my"))
    return places.in_any_zone(middles, zones(spark, sf)).select("point_id")


add("j14_spans_in_zones", j14_spans_in_zones,
    f"{POINTS_SQL}, {ZONES_SQL} SELECT point_id FROM pt WHERE EXISTS (SELECT 1 FROM zn WHERE zn.patch_id = pt.patch_id AND sqrt((px - zx) ** 2 + (py - zy) ** 2) <= zone_m)")


def j15_runway_names(spark, sf):
    every, k = airports(spark, sf), F.col("id")
    runways = every.where("source <> 'aerodrome'").select(k.alias("runway_id"), (F.col("lat") + 0.01).alias("lat"), "lon", F.when(k % 7 == 0, "ref").alias("ref"))
    box = {"lat_min": F.col("lat") - 0.02 - k % 5 / 1000.0, "lat_max": F.col("lat") + 0.02, "lon_min": F.col("lon") - 0.02, "lon_max": F.col("lon") + 0.02,
        "c_lat": F.col("lat"), "c_lon": F.col("lon")}
    aerodromes = every.where("source = 'aerodrome'").select(F.concat("name", F.lit("-"), k.cast("string")).alias("name"), *[c.alias(n) for n, c in box.items()])
    return places.runway_names(runways, aerodromes)


add("j15_runway_names", j15_runway_names, AIRPORT_SQL + """,
rw AS (SELECT id AS runway_id, lat + 0.01 AS lat, lon, CASE WHEN id % 7 = 0 THEN 'ref' END AS ref FROM ap WHERE source <> 'aerodrome'),
ae AS (SELECT name || '-' || id AS name, lat - 0.02 - id % 5 / 1000.0::DOUBLE AS a0, lat + 0.02 AS a1, lon - 0.02 AS o0, lon + 0.02 AS o1, lat AS cl, lon AS co FROM ap WHERE source = 'aerodrome'),
mt AS (
  SELECT runway_id, ref, name, lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1 AS inside, (a1 - a0) * (o1 - o0) AS box,
    sqrt(((lon - co) * 111320.0::DOUBLE * cos(radians((lat + cl) / 2))) ** 2 + ((lat - cl) * 111320.0::DOUBLE) ** 2) AS m
  FROM rw LEFT JOIN ae ON abs(lat - cl) < 0.2 AND abs(lon - co) < 0.2
)
SELECT runway_id, coalesce(arg_min(name, (box, name)) FILTER (inside), arg_min(name, (m, name)) FILTER (m <= 5000), ref, 'airport') AS name FROM mt GROUP BY runway_id, ref""")


def j16_best_zone_source(spark, sf):
    ranked = airports(spark, sf).select("patch_id", "id", F.when(F.col("patch_id").endswith("0"), 2).when(F.col("source") == "aerodrome", 2).otherwise(1).alias("priority"))
    return places.best_zone_source(ranked).select("patch_id", "id", "priority")


add("j16_best_zone_source", j16_best_zone_source, AIRPORT_SQL + """,
pr AS (SELECT patch_id, id, CASE WHEN patch_id LIKE '%0' OR source = 'aerodrome' THEN 2 ELSE 1 END AS priority FROM ap)
SELECT patch_id, id, priority FROM pr QUALIFY dense_rank() OVER (PARTITION BY patch_id ORDER BY priority) = 1""")


def projected_patches(spark, sf) -> DataFrame:
    """A patch around each supplier's site: its zone, box and the offsets that put its centre at the origin."""
    k = F.col("s_suppkey")
    site = table(spark, sf, "supplier").select(F.format_string("%03d%03d", (k % 1000).cast("int"), F.floor(k / 1000).cast("int")).alias("patch_id"),
        (F.lit(40.005) + k * 10 % 1000 / 100.0).alias("c_lat"), (F.lit(12.005) + k * 10 % 600 / 100.0).alias("c_lon"))
    centre = site.withColumn("c", geo.project_utm(F.col("c_lat"), F.col("c_lon"), F.lit(33), F.lit(0.0), F.lit(0.0)))
    box = {"lat_min": F.col("c_lat") - 0.03, "lat_max": F.col("c_lat") + 0.03, "lon_min": F.col("c_lon") - 0.05, "lon_max": F.col("c_lon") + 0.05}
    return centre.select("patch_id", F.lit(33).alias("zone"), (-F.col("c.x")).alias("tx"), (-F.col("c.y")).alias("ty"), *[c.alias(n) for n, c in box.items()])


def utm_sql(source: str, name: str, lat: str, lon: str, x: str, y: str) -> str:
    """CTE ``name``: rows of ``source`` with their projection into zone 33."""
    e2 = geo.ECC2
    ep = e2 / (1 - e2)
    arc = f"({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * f - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * f) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * f) - {35 * e2**3 / 3072!r} * sin(6 * f))"
    return f"""
{name}0 AS (SELECT *, radians({lat}) AS f, radians({lon} - 15) AS l FROM {source}),
{name}1 AS (SELECT *, {geo.RADIUS} / sqrt(1 - {e2} * sin(f) * sin(f)) AS n, tan(f) * tan(f) AS t, {ep} * cos(f) * cos(f) AS c, cos(f) * l AS q, {geo.RADIUS} * {arc} AS m FROM {name}0),
{name} AS (
  SELECT * EXCLUDE (f, l, n, t, c, q, m), 0.9996 * n * (q + (1 - t + c) * q ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep!r}) * q ** 5 / 120) + 500000 AS {x},
    0.9996 * (m + n * tan(f) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * q ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {ep!r}) * q ** 6 / 720)) AS {y} FROM {name}1
)"""


def j17_airports_in_patch(spark, sf):
    found = places.airports_in_patches(airports(spark, sf).select("id", "lat", "lon"), projected_patches(spark, sf))
    return found.select("patch_id", "id", r3(F.col("x")).alias("x"), r3(F.col("y")).alias("y"))


add("j17_airports_in_patch", j17_airports_in_patch, f"""{AIRPORT_SQL},
sp AS (SELECT printf('%03d%03d', s_suppkey % 1000, s_suppkey // 1000) AS patch_id, 40.005::DOUBLE + s_suppkey * 10 % 1000 / 100.0::DOUBLE AS c_lat, 12.005::DOUBLE + s_suppkey * 10 % 600 / 100.0::DOUBLE AS c_lon FROM supplier),
{utm_sql('sp', 'su', 'c_lat', 'c_lon', 'cx', 'cy')},
ne AS (SELECT su.patch_id, id, cx, cy, lat, lon FROM su JOIN ap ON abs(lat - c_lat) < 0.1 AND abs(lon - c_lon) < 0.1), {utm_sql('ne', 'pj', 'lat', 'lon', 'ux', 'uy')}
SELECT patch_id, id, round(ux - cx, 3) + 0 AS x, round(uy - cy, 3) + 0 AS y FROM pj WHERE abs(ux - cx) <= 2880 AND abs(uy - cy) <= 2880""")


def a21_merged_boxes(spark, sf):
    """Boxes around the patches of each column, and around all."""
    patches = projected_patches(spark, sf).withColumn("landscape", F.substring("patch_id", 1, 1))
    every = places.merged_box(patches, ["landscape"]).unionByName(places.merged_box(patches.withColumn("landscape", F.lit("all")), ["landscape"]))
    return every.select("landscape", *[F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


add("a21_merged_boxes", a21_merged_boxes, """
sp AS (SELECT printf('%03d', s_suppkey % 1000) AS col, 40.005::DOUBLE + s_suppkey * 10 % 1000 / 100.0::DOUBLE AS a,
  12.005::DOUBLE + s_suppkey * 10 % 600 / 100.0::DOUBLE AS o FROM supplier), ls AS (SELECT *, unnest([left(col, 1), 'all']) AS landscape FROM sp)
SELECT landscape, round(min(a - 0.03), 6) AS lat_min, round(max(a + 0.03), 6) AS lat_max, round(min(o - 0.05), 6) AS lon_min, round(max(o + 0.05), 6) AS lon_max FROM ls GROUP BY landscape""")


# Second sources


def second_source(spark, sf) -> DataFrame:
    return footprints(spark, sf, second=True).withColumn("osm_id", F.concat(F.lit("m"), "osm_id"))


def j12_overlaps(spark, sf):
    return places.overlapping(footprints(spark, sf), second_source(spark, sf))


def _second_sql() -> str:
    """The CTEs of the second source under names that begin with m."""
    sql = ML_SQL
    for old, new in (("base0", "mbase0"), ("base AS", "mbase AS"), ("FROM base)", "FROM mbase)"), ("FROM base ", "FROM mbase "), ("fp AS", "mfp AS"),
        ("FROM fp", "FROM mfp"), ("rv0", "mrv0"), ("rv AS", "mrv AS"), ("FROM rv", "FROM mrv"), ("edges AS", "medges AS")):
        sql = sql.replace(old, new)
    return sql


_ODD = "sum(CASE WHEN ((y > py) <> (y2 > py)) AND px < (x2 - x) * (py - y) / (y2 - y) + x THEN 1 ELSE 0 END) % 2 = 1"
OVERLAPS_SQL = f"""{FOOTPRINTS_SQL}, {_second_sql()}
, bx AS (SELECT patch_id, osm_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my FROM rv WHERE ring_no = 0 GROUP BY ALL),
mb AS (SELECT patch_id, osm_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my FROM mrv WHERE ring_no = 0 GROUP BY ALL),
pr AS (SELECT b.osm_id AS bid, m.osm_id AS mid, b.patch_id, b.mx AS bmx, b.my AS bmy, m.mx AS mmx, m.my AS mmy FROM bx b JOIN mb m ON b.patch_id = m.patch_id AND b.x0 <= m.x1 AND b.x1 >= m.x0 AND b.y0 <= m.y1 AND b.y1 >= m.y0),
tst AS (
  SELECT patch_id, bid, mid, 'b' AS ring, mmx AS px, mmy AS py FROM pr UNION ALL SELECT pr.patch_id, bid, mid, 'b', x, y FROM pr JOIN mrv v ON v.osm_id = mid AND ring_no = 0
  UNION ALL SELECT patch_id, bid, mid, 'm', bmx, bmy FROM pr UNION ALL SELECT pr.patch_id, bid, mid, 'm', x, y FROM pr JOIN rv v ON v.osm_id = bid AND ring_no = 0
),
hit AS (
  SELECT t.patch_id, mid, bid, ring, px, py FROM tst t JOIN edges e ON ring = 'b' AND e.osm_id = bid AND e.ring_no = 0 GROUP BY ALL HAVING {_ODD}
  UNION ALL SELECT t.patch_id, mid, bid, ring, px, py FROM tst t JOIN medges e ON ring = 'm' AND e.osm_id = mid AND e.ring_no = 0 GROUP BY ALL HAVING {_ODD}
)"""
add("j12_overlaps", j12_overlaps, OVERLAPS_SQL + "SELECT DISTINCT patch_id, 'm' || mid AS other_id FROM hit")


def e2_merged_sources(spark, sf):
    merged = places.merged_sources(footprints(spark, sf), second_source(spark, sf))
    return merged.groupBy("patch_id", "source").agg(F.count("*").alias("n"), F.min(F.col("osm_id").try_cast("bigint")).alias("least_id"), F.countDistinct("osm_id").alias("ids"))


add("e2_merged_sources", e2_merged_sources, OVERLAPS_SQL + """,
ad AS (SELECT patch_id, osm_id FROM mb WHERE osm_id NOT IN (SELECT mid FROM hit))
SELECT patch_id, 'base' AS source, count(*) AS n, min(osm_id::BIGINT) AS least_id, count(*) AS ids FROM bx GROUP BY patch_id UNION ALL SELECT patch_id, 'ml', count(*),
  -count(*), count(*) FROM ad GROUP BY patch_id""")


def j18_tiles_needed(spark, sf):
    """A box for each customer's site; the index has the tiles of every third site."""
    every = airports(spark, sf)
    boxes = every.select(F.format_string("%06d", "id").alias("patch_id"), F.col("lat").alias("lat_min"), (F.col("lat") + 0.5).alias("lat_max"),
        F.col("lon").alias("lon_min"), (F.col("lon") + 0.7).alias("lon_max"))
    index = every.where("id % 3 = 0").groupBy(geo.quadkey(F.col("lat"), F.col("lon")).alias("quadkey")).agg(F.sort_array(F.collect_set("source")).alias("urls"))
    return places.tiles_needed(boxes, index).groupBy("patch_id").agg(F.count("*").alias("tiles"), F.sum(F.size("urls")).cast("bigint").alias("urls"))


_TILE = "floor((lon + 180) / 360 * 512)::BIGINT AS tx, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 512)::BIGINT AS ty"
add("j18_tiles_needed", j18_tiles_needed, f"""{AIRPORT_SQL},
c5 AS (SELECT printf('%06d', id) AS patch_id, unnest([lat, lat, lat + 0.5, lat + 0.5, (lat + lat + 0.5) / 2]) AS lat, unnest([lon, lon + 0.7, lon, lon + 0.7, (lon + lon + 0.7) / 2]) AS lon FROM ap),
tt AS (SELECT DISTINCT patch_id, {_TILE} FROM c5), ix AS (SELECT tx, ty, count(DISTINCT source) AS urls FROM (SELECT source, {_TILE} FROM ap WHERE id % 3 = 0) GROUP BY tx, ty)
SELECT patch_id, count(*) AS tiles, coalesce(sum(urls), 0)::BIGINT AS urls FROM tt LEFT JOIN ix USING (tx, ty) GROUP BY patch_id""")


def j19_e5_added_only(spark, sf):
    """Names of a third of the sites are known; those of the others come in where they are new."""
    named = airports(spark, sf).select("id", F.concat("name", F.lit("-"), (F.col("id") % 7).cast("string")).alias("name"))
    known = named.where("id % 3 = 0").select("name", F.lit("known").alias("origin")).distinct()
    return places.added_only(known, named.where("id % 3 <> 0").select("name", F.lit("side").alias("origin")).distinct(), ["name"])


add("j19_e5_added_only", j19_e5_added_only, AIRPORT_SQL + """
SELECT name || '-' || id % 7 AS name, CASE WHEN bool_or(id % 3 = 0) THEN 'known' ELSE 'side' END AS origin FROM ap GROUP BY 1""")


def s8_patch_grid(spark, sf):
    """The grid over all patches that have buildings, with their number of orders."""
    patches = table(spark, sf, "orders").groupBy(patch_name(F.col("o_custkey") % 25).alias("patch_id")).agg(F.count("*").alias("n"))
    col, row = F.substring("patch_id", 1, 3).cast("int"), F.substring("patch_id", 4, 3).cast("int")
    bounds = patches.agg(F.min(col), F.max(col), F.min(row), F.max(row)).first()
    grid = readers.patch_grid(spark, *bounds)
    return grid.join(patches, "patch_id", "left").select("patch_id", F.coalesce("n", F.lit(0)).alias("n"))


add("s8_patch_grid", s8_patch_grid, """
p AS (SELECT (o_custkey % 25) % 5 AS x, (o_custkey % 25) // 5 AS y, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT unnest(generate_series(x0, x1)) AS x, y0, y1 FROM b), h AS (SELECT x, unnest(generate_series(y0, y1)) AS y FROM g)
SELECT printf('%03d%03d', x, y) AS patch_id, coalesce(n, 0) AS n FROM h LEFT JOIN p USING (x, y)""")
