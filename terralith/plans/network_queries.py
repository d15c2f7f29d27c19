"""Queries over polylines from ``events``, points, tiles and projections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import geo, tags
from terralith.operators import networks as net
from terralith.plans.derived import table

Q: dict = {}
O: dict = {}  # noqa: E741

LINES_SQL = """
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
pts AS (SELECT printf('%03d%03d', user_id % 5, (user_id // 5) % 5) AS patch_id, 'w' || user_id AS way_id, user_id, pos, (event_id * 7919) % 8000 - 4000.0::double AS x,
  (event_id * 104729) % 8000 - 4000.0::double AS y, event_type <> 'error' AS is_support FROM ev),
lp AS (SELECT *, x BETWEEN -2880 AND 2880 AND y BETWEEN -2880 AND 2880 AS in_patch FROM pts),
lt AS (SELECT DISTINCT patch_id, way_id, CASE user_id % 5 WHEN 2 THEN 'minor_line' WHEN 3 THEN 'cable' ELSE 'line' END AS power, CASE user_id % 6 WHEN 1 THEN '400000'
  WHEN 2 THEN '110000;20000' WHEN 3 THEN '45000' WHEN 4 THEN '230' WHEN 5 THEN '33 kV' END AS voltage, CASE WHEN user_id % 4 = 0 THEN 'north' END AS name FROM lp),
lk AS (SELECT *, CASE voltage WHEN '400000' THEN 400 WHEN '110000;20000' THEN 110 WHEN '45000' THEN 45 WHEN '230' THEN 0.23 WHEN '33 kV' THEN 33 END::double AS kv FROM lt),
lc AS (SELECT *, CASE WHEN kv >= 110 THEN 'large' WHEN kv >= 45 THEN 'medium' WHEN kv IS NOT NULL THEN 'small' WHEN power = 'minor_line' THEN 'small'
  WHEN name IS NOT NULL THEN 'large' ELSE 'medium' END AS kind FROM lk),
lw AS (SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb, lag(in_patch) OVER w AS was_in,
  bool_or(in_patch) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS placed FROM lp WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
ls AS (SELECT *, sqrt((xb - x) * (xb - x) + (yb - y) * (yb - y)) AS span_m, CASE WHEN in_patch THEN sum(CASE WHEN in_patch AND NOT coalesce(was_in,
  FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) END AS run_id FROM lw),
st AS (SELECT patch_id, way_id, count(*) AS points, count_if(is_support)::BIGINT AS supports, coalesce(sum(CASE WHEN was_in <> in_patch THEN 1 ELSE 0 END),
  0)::BIGINT AS transitions, coalesce(max(run_id), 0)::BIGINT AS runs, round(max(span_m), 6) AS max_span_m, CASE WHEN count_if(in_patch) = count(*) THEN 'inside'
  WHEN count_if(in_patch) = 0 THEN 'outside' ELSE 'crossing' END AS status FROM ls GROUP BY ALL),
un AS (SELECT *, (x - xa) / nullif(sqrt((x - xa) * (x - xa) + (y - ya) * (y - ya)), 0) AS ux, (y - ya) / nullif(sqrt((x - xa) * (x - xa) + (y - ya) * (y - ya)),
  0) AS uy, (xb - x) / nullif(span_m, 0) AS vx, (yb - y) / nullif(span_m, 0) AS vy FROM ls),
sm AS (SELECT *, coalesce(ux, 0) + coalesce(vx, 0) AS sx, coalesce(uy, 0) + coalesce(vy, 0) AS sy FROM un),
yw0 AS (SELECT *, degrees(CASE WHEN abs(sx) < 1e-6 AND abs(sy) < 1e-6 THEN atan2(coalesce(vy, 0), coalesce(vx, 0)) ELSE atan2(sy, sx) END) + 90 AS raw FROM sm),
yw AS (SELECT *, raw - floor(raw / 360) * 360 AS yaw_deg, 100.0::double + pos AS foot_z FROM yw0),
att AS (SELECT * FROM (VALUES ('large', 0, -13.7, 27.8, 5.0), ('large', 1, 0.0, 27.8, 5.0), ('large', 2, 13.7, 27.8, 5.0), ('medium', 0, -6.2, 15.24, 2.5), ('medium', 1,
  5.85, 18.16, 2.5), ('medium', 2, -5.12, 21.04, 2.5), ('medium', 3, 0.0, 26.4, 2.5), ('small', 0, -0.75, 5.55, 1.2), ('small', 1, 0.75, 5.55, 1.2)) t(kind, wire,
  across, up, sag)),
pr AS (SELECT yw.*, lead(yaw_deg) OVER w AS yaw2, lead(foot_z) OVER w AS foot2, lead(placed) OVER w AS placed2 FROM yw WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
cb AS (SELECT pr.patch_id, pr.way_id, pos, lc.kind, wire, sag::double AS sag, x + across * cos(radians(yaw_deg)) AS x1, y + across * sin(radians(yaw_deg)) AS y1,
  foot_z + up AS z1, xb + across * cos(radians(yaw2)) AS x2, yb + across * sin(radians(yaw2)) AS y2, foot2 + up AS z2,
    greatest(2, least(14, ceil(sqrt(sag / 0.15))))::INT AS ns FROM pr JOIN lc USING (way_id) JOIN att USING (kind) WHERE placed AND placed2 AND power IN ('line',
      'minor_line') AND coalesce(kv >= 1, TRUE))
"""
# A lat/lon for each customer, over one zone.
SITES_SQL = """
site AS (SELECT c_custkey AS id, 40 + (c_custkey % 1000) / 100.0::double AS lat, 12.0::double + (c_custkey % 600) / 100.0::double AS lon FROM customer)
"""


def add(name: str, query, sql: str | None = None, base: str = LINES_SQL) -> None:
    Q[name] = query
    if sql:
        O[name] = f"WITH {base}{sql}"


def points(spark, sf):
    from pyspark.sql import Window

    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type").withColumn("pos",
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint"))
    u, e = F.col("user_id"), F.col("event_id")
    xy = ev.select(
        F.format_string("%03d%03d", (u % 5).cast("int"), (F.floor(u / 5) % 5).cast("int")).alias("patch_id"), F.concat(F.lit("w"), u.cast("string")).alias("way_id"), "user_id", "pos",
        ((e * 7919) % 8000 - 4000).cast("double").alias("x"), ((e * 104729) % 8000 - 4000).cast("double").alias("y"), (F.col("event_type") != "error").alias("is_support"),
    )
    return xy.withColumn("in_patch", F.col("x").between(-2880, 2880) & F.col("y").between(-2880, 2880))


def lines(spark, sf):
    u = F.col("user_id")
    every = points(spark, sf).select("patch_id", "way_id", "user_id").distinct()
    tagged = every.withColumns(
        {
            "power": F.when(u % 5 == 2, "minor_line").when(u % 5 == 3, "cable").otherwise("line"),
            "voltage": F.when(u % 6 == 1, "400000").when(u % 6 == 2, "110000;20000").when(u % 6 == 3, "45000").when(u % 6 == 4, "230").when(u % 6 == 5, "33 kV"),
            "name": F.when(u % 4 == 0, "north"),
        }
    )
    kv = tagged.withColumn("kv", tags.voltage_kv(F.col("voltage")))
    return kv.withColumn("kind", tags.line_class(F.col("kv"), F.col("power"), F.col("name"))).drop("user_id")


def drawn(spark, sf):
    own = lines(spark, sf).where(tags.is_drawable(F.col("power"), F.col("kv")))
    return points(spark, sf).join(own, ["patch_id", "way_id"]).withColumn("foot_z", F.lit(100.0) + F.col("pos"))


r4 = lambda c: F.round(c, 4) + F.lit(0.0)
add("p22_voltage", lambda s, d: lines(s, d).select("way_id", F.round("kv", 6).alias("kv")), "SELECT way_id, round(kv, 6) AS kv FROM lk")
add("p23_line_class", lambda s, d: lines(s, d).groupBy("power", "kind").agg(F.count("*").alias("n")), "SELECT power, kind, count(*) AS n FROM lc GROUP BY ALL")
add("p25_high_voltage", lambda s, d: lines(s, d).select("way_id", tags.is_high_voltage(F.col("kv"), F.col("kind")).alias("hv")), "SELECT way_id, coalesce(kv >= 69, kind = 'large') AS hv FROM lc")
add("f4_drawable_line", lambda s, d: lines(s, d).where(tags.is_drawable(F.col("power"), F.col("kv"))).groupBy("power").agg(F.count("*").alias("n")),
    "SELECT power, count(*) AS n FROM lc WHERE power IN ('line', 'minor_line') AND coalesce(kv >= 1, TRUE) GROUP BY ALL")
add("f6_in_patch", lambda s, d: points(s, d).groupBy("patch_id", "in_patch").agg(F.count("*").alias("n")), "SELECT patch_id, in_patch, count(*) AS n FROM lp GROUP BY ALL")
add("f7_usable_line", lambda s, d: points(s, d).groupBy("patch_id", "way_id").agg(F.count("*").alias("points")).where("points >= 2"),
    "SELECT patch_id, way_id, count(*) AS points FROM lp GROUP BY ALL HAVING count(*) >= 2")
add("j5_supports", lambda s, d: points(s, d).where("is_support").groupBy("way_id").agg(F.count("*").alias("supports")), "SELECT way_id, count(*) AS supports FROM lp WHERE is_support GROUP BY ALL")
add("w5_spans", lambda s, d: net.spans(points(s, d)).select("way_id", "pos", F.round("span_m", 6).alias("span_m")), "SELECT way_id, pos, round(span_m, 6) AS span_m FROM ls")
add("w6_w8_line_statistics", lambda s, d: net.line_statistics(points(s, d)), "SELECT * FROM st")
add("w7_runs", lambda s, d: net.runs(points(s, d)).where("run_id IS NOT NULL").groupBy("way_id", "run_id")
    .agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")), "SELECT way_id, run_id::BIGINT AS run_id, "
"min(pos) AS first_pos, max(pos) AS last_pos FROM ls WHERE run_id IS NOT NULL GROUP BY ALL")
add("w9_placed", lambda s, d: net.placed(points(s, d)).select("way_id", "pos", "placed"), "SELECT way_id, pos, placed FROM lw")
add("w10_yaw", lambda s, d: net.with_yaw(points(s, d)).select("way_id", "pos", r4(F.col("yaw_deg")).alias("yaw_deg")), "SELECT way_id, pos, round(yaw_deg, 4) + 0 AS yaw_deg FROM yw")
add("w12_placed_runs", lambda s, d: net.placed_runs(points(s, d)).select("way_id", "first_pos", "last_pos", "points"),
    ", q AS (SELECT *, sum(CASE WHEN placed AND NOT coalesce(lag_placed, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) AS r FROM (SELECT *, "
    "lag(placed) OVER (PARTITION BY way_id ORDER BY pos) AS lag_placed FROM lw)) SELECT way_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS points FROM q "
    "WHERE placed GROUP BY way_id, r HAVING count(*) >= 2")
add("w13_g15_equal_spacing", lambda s, d: net.equally_spaced(points(s, d), 77.5).groupBy("way_id")
    .agg(F.count("*").alias("items"), F.max("item").alias("last_item"), F.round(F.sum("x"), 2).alias("sum_x")),
    ", cu AS (SELECT *, coalesce(sum(span_m) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_m FROM ls), "
    "it AS (SELECT *, unnest(generate_series(ceil(round(from_m / 77.5, 9))::BIGINT, ceil(round((from_m + span_m) / 77.5, 9))::BIGINT - 1)) AS item FROM cu "
    "WHERE span_m > 1e-6) SELECT way_id, count(*) AS items, max(item) AS last_item, round(sum(x + (xb - x) * (item * 77.5 - from_m) / span_m), 2) AS sum_x FROM it "
    "GROUP BY ALL")
add("a17_class_statistics", lambda s, d: net.class_statistics(net.line_statistics(points(s, d)).join(lines(s, d), ["patch_id", "way_id"])),
    "SELECT kind, count(*) AS lines, sum(supports)::BIGINT AS supports, count_if(status = 'inside')::BIGINT AS inside, count_if(status = 'outside')::BIGINT AS outside, "
    "count_if(status = 'crossing')::BIGINT AS crossing, count_if(runs > 1)::BIGINT AS multi_run FROM st JOIN lc USING (way_id) GROUP BY ALL")
add("t1_line_report", lambda s, d: net.line_statistics(points(s, d)).select("way_id", "runs", "points").orderBy(F.desc("runs"), F.desc("points"), "way_id"),
    "SELECT way_id, runs, points FROM st ORDER BY runs DESC, points DESC, way_id")
add("g12_conductors", lambda s, d: net.conductor_spans(drawn(s, d))
    .select("way_id", "pos", "wire", *[r4(F.col(c)).alias(c) for c in ("x1", "y1", "z1", "x2", "y2", "z2")]), "SELECT way_id, pos, wire, " + ", "
    .join(f"round({c}, 4) + 0 AS {c}" for c in ("x1", "y1", "z1", "x2", "y2", "z2")) + " FROM cb")
add("g13_cable_samples", lambda s, d: net.cable_samples(net.conductor_spans(drawn(s, d))).groupBy("way_id", "wire").agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("sum_z")),
    ", sa AS (SELECT *, unnest(generate_series(0, ns)) / ns::double AS t FROM cb) SELECT way_id, wire, count(*) AS n, "
    "round(sum(z1 + (z2 - z1) * t - 4 * sag * t * (1 - t)), 3) AS sum_z FROM sa GROUP BY ALL")
add("a18_placement_statistics", lambda s, d: net.conductor_spans(drawn(s, d)).groupBy("kind")
    .agg(F.count("*").alias("cables"), F.countDistinct("way_id", "pos").alias("spans")),
    "SELECT kind, count(*) AS cables, count(DISTINCT (way_id, pos)) AS spans FROM cb GROUP BY ALL")
add("g11_towers", lambda s, d: net.with_yaw(net.placed(drawn(s, d))).where("placed")
    .select("way_id", "pos", "kind", "foot_z", r4(F.col("yaw_deg")).alias("yaw_deg")), "SELECT way_id, pos, kind, foot_z, round(yaw_deg, "
"4) + 0 AS yaw_deg FROM yw JOIN lc USING (way_id) WHERE placed AND power IN ('line', 'minor_line') AND coalesce(kv >= 1, TRUE)")


def sites(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.lit(40.0) + F.col("c_custkey") % 1000 / 100.0).alias("lat"), (F.lit(12.0) + F.col("c_custkey") % 600 / 100.0).alias("lon"))


_E, _P = geo.ECC2, geo.ECC2 / (1 - geo.ECC2)
add("p1_project_utm", lambda s, d: sites(s, d).withColumn("p", geo.project_utm(F.col("lat"), F.col("lon"), F.lit(33), F.lit(0.0), F.lit(0.0)))
    .select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y")),
    f""", a AS (SELECT *, radians(lat) AS f, radians(lon - 15) AS l FROM site), b AS (SELECT *, {geo.RADIUS} / sqrt(1 - {_E} * sin(f) * sin(f)) AS n, tan(f) * tan(f) AS t, {_P} * cos(f) * cos(f) AS c, cos(f) * l AS q, {geo.RADIUS} * ({1 - _E / 4 - 3 * _E**2 / 64 - 5 * _E**3 / 256!r} * f - {3 * _E / 8 + 3 * _E**2 / 32 + 45 * _E**3 / 1024!r} * sin(2 * f) + {15 * _E**2 / 256 + 45 * _E**3 / 1024!r} * sin(4 * f) - {35 * _E**3 / 3072!r} * sin(6 * f)) AS m FROM a)
    SELECT id, round(0.9996 * n * (q + (1 - t + c) * q ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_P!r}) * q ** 5 / 120) + 500000, 3) AS x, round(0.9996 * (m + n * tan(f) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * q ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_P!r}) * q ** 6 / 720)), 3) AS y FROM b""", SITES_SQL)
add("p27_quadkey", lambda s, d: sites(s, d).select("id", geo.quadkey(F.col("lat"), F.col("lon")).alias("quadkey")),
    ", t AS (SELECT id, floor((lon + 180) / 360 * 512)::BIGINT AS tx, "
    "floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 512)::BIGINT AS ty FROM site) SELECT id, " + " || "
        .join(f"(((tx >> {i}) & 1) + 2 * ((ty >> {i}) & 1))::VARCHAR" for i in range(8, -1, -1)) + " AS quadkey FROM t", SITES_SQL)
add("p28_distance", lambda s, d: sites(s, d).select("id", F.round(geo.distance_m(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(15.0)), 3).alias("metres")),
    "SELECT id, round(sqrt(((lon - 15) * 111320.0::double * cos(radians((lat + 45) / 2))) ** 2 + ((lat - 45) * 111320.0::double) ** 2), 3) AS metres FROM site", SITES_SQL)
add("p31_box_error", lambda s, d: sites(s, d).select("id", geo.box_error(F.col("lat") - F.col("id") % 7 / 10.0, F.col("lat"), F.col("lon") - F.col("id") % 5 / 10.0, F.col("lon")).alias("error")),
    "SELECT id, CASE WHEN id % 7 = 0 THEN 'lat_min must be less than lat_max' WHEN id % 5 = 0 THEN 'lon_min must be less than lon_max' "
    "WHEN (lat - (lat - id % 7 / 10.0::double)) * (lon - (lon - id % 5 / 10.0::double)) > 0.25 THEN 'Bounding box too large' ELSE '' END AS error FROM site", SITES_SQL)
add("p30_centre_span", lambda s, d: sites(s, d).withColumn("c", geo.centre_span(F.col("lat"), F.col("lat") + 0.5, F.col("lon"), F.col("lon") + 0.25))
    .select("id", *[F.round(f"c.{n}", 9).alias(n) for n in ("lat", "lon", "lat_span", "lon_span")]),
    "SELECT id, round((lat + lat + 0.5) / 2, 9) AS lat, round((lon + lon + 0.25) / 2, 9) AS lon, 0.5::double AS lat_span, 0.25::double AS lon_span FROM site", SITES_SQL)
add("p32_wall_u_range", lambda s, d: sites(s, d).withColumn("u", geo.wall_u_range(F.col("id") % 400 / 10.0))
    .select("id", F.round("u.u0", 9).alias("u0"), F.round("u.u1", 9).alias("u1")), "SELECT id, round(1.0::double / 3, 9) AS u0, "
"round(1.0::double / 3 + greatest(1, ceil(round((id % 400) / 10.0::double / 3, 9))) / 3, 9) AS u1 FROM site", SITES_SQL)
add("p33_v_ranges", lambda s, d: sites(s, d).withColumns({"r": geo.roof_v_range(F.col("id") % 6), "f": geo.facade_v_range(F.col("id") % 12, F.lit(1)),
    "g": geo.highrise_v_range(F.col("id") % 12)}).select("id", *[F.round(f"{a}.{b}", 9).alias(f"{a}_{b}") for a in "rfg" for b in ("v0", "v1")]),
    "SELECT id, round(1 - (id % 6 + 1) / 24.0::double, 9) AS r_v0, round(1 - (id % 6) / 24.0::double, 9) AS r_v1, "
    "round(0.75 - (id % 12) / 16.0::double - 2 / 48.0::double, 9) AS f_v0, round(0.75 - (id % 12) / 16.0::double - 1 / 48.0::double, 9) AS f_v1, "
    "round(1 - (id % 12 + 1) / 12.0::double, 9) AS g_v0, round(1 - (id % 12) / 12.0::double, 9) AS g_v1 FROM site", SITES_SQL)
add("p34_uv", lambda s, d: points(s, d).withColumns({"o": geo.orthophoto_uv(F.col("x"), F.col("y")),
    "a": geo.aligned_uv(F.col("x"), F.col("y"), F.lit(10.0), F.lit(20.0), F.lit(30.0))})
    .select("way_id", "pos", *[r4(F.col(c)).alias(n) for c, n in (("o.u", "u"), ("o.v", "v"), ("a.u", "au"), ("a.v", "av"))]),
    "SELECT way_id, pos, round((x + 2880) / 5760, 4) + 0 AS u, round((y + 2880) / 5760, 4) + 0 AS v, round(((x - 10) * cos(radians(-30)) - (y - 20) * sin(radians(-30))), "
    "4) + 0 AS au, round(((x - 10) * sin(radians(-30)) + (y - 20) * cos(radians(-30))), 4) + 0 AS av FROM lp")
add("g16_mosaic_offset", lambda s, d: lines(s, d).select("patch_id").distinct().withColumn("o", geo.mosaic_offset(F.col("patch_id"), 1, 2))
    .select("patch_id", "o.dx", "o.dy"), "SELECT DISTINCT patch_id, -(left(patch_id, "
"3)::INT - 1) * 5760.0::double + 0 AS dx, (right(patch_id, 3)::INT - 2) * 5760.0::double AS dy FROM lp")


def ball_spans(spark, sf):
    """Top cables of all drawn lines with what decides their balls; feet lie up to 80 m above the terrain's foot."""
    from terralith.plans import place_queries as pl

    cables = net.conductor_spans(drawn(spark, sf).withColumn("foot_z", F.lit(100.0) + F.col("pos") % 40))
    top = cables.join(F.broadcast(net.top_wires(spark)), ["kind", "wire"])
    high = lines(spark, sf).select("patch_id", "way_id", tags.is_high_voltage(F.col("kv"), F.col("kind")).alias("hv"))
    return net.ball_spans(top, pl.triangles(spark, sf), pl.zones(spark, sf), high, pl.CELL_M)


def g14_ball_modes(spark, sf):
    """Spans by why they have balls."""
    found = ball_spans(spark, sf)
    return found.groupBy("kind", "wire", "in_zone", "spacing").agg(F.count("*").alias("n"), F.round(F.sum("clearance"), 2).alias("clearance"))


def g14_marker_balls(spark, sf):
    balls = net.marker_balls(ball_spans(spark, sf), F.col("spacing"))
    return balls.groupBy("way_id").agg(F.count("*").alias("balls"), *[F.round(F.sum(c), 2).alias(f"sum_{c}") for c in "xyz"])


def _balls_sql() -> str:
    """CTE bm: top cables with hv, clearance, in_zone and spacing."""
    from terralith.plans import place_queries as pl

    lifted = LINES_SQL.replace("100.0::double + pos AS foot_z", "100.0::double + pos % 40 AS foot_z")
    return f"""{lifted}, {pl.TERRAIN_SQL}, {pl.ZONES_SQL},
    tc AS (SELECT cb.*, coalesce(kv >= 69, cb.kind = 'large') AS hv FROM cb JOIN (SELECT way_id, kv FROM lc) USING (way_id) WHERE (cb.kind, wire) IN (('large', 1), ('medium', 3), ('small', 0))),
    th AS (SELECT tc.*, t, x1 + (x2 - x1) * t AS px, y1 + (y2 - y1) * t AS py, z1 + (z2 - z1) * t - 4 * sag * t * (1 - t) AS cz FROM tc, (VALUES (0.25::DOUBLE), (0.5), (0.75)) v(t)),
    {pl.elevation_sql("th", "tz")},
    cl AS (SELECT way_id, pos, greatest(0, coalesce(max(cz - z), 0)) AS clearance FROM tz GROUP BY ALL),
    bz AS (SELECT tc.*, clearance, EXISTS (SELECT 1 FROM zn WHERE zn.patch_id = tc.patch_id AND sqrt(((x1 + x2) / 2 - zx) ** 2 + ((y1 + y2) / 2 - zy) ** 2) <= zone_m) AS in_zone FROM tc JOIN cl USING (way_id, pos)),
    bm AS (SELECT *, CASE WHEN clearance > 45 THEN 60 WHEN in_zone THEN CASE WHEN hv THEN 30 ELSE 40 END END::DOUBLE AS spacing FROM bz)
    """


def add_ball_queries() -> None:
    """Their SQL needs the terrain's, whose module needs this one's tables."""
    Q["g11_turbine_placements"], O["g11_turbine_placements"] = g11_turbine_placements, f"WITH {_turbines_sql().strip()}"
    base = _balls_sql()
    add("g14_ball_modes", g14_ball_modes, "SELECT kind, wire, in_zone, spacing, count(*) AS n, round(sum(clearance), 2) AS clearance FROM bm GROUP BY kind, wire, in_zone, spacing", base)
    add("g14_marker_balls", g14_marker_balls, """
    , sp AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS span FROM bm WHERE spacing IS NOT NULL), nb AS (SELECT *, greatest(1, round_even(span / spacing,
      0))::INT AS balls FROM sp WHERE span > 1e-6),
    ba AS (SELECT *, (unnest(generate_series(0, balls - 1)) + 0.5::double) / balls AS t FROM nb), se AS (SELECT *, least(floor(t * ns), ns - 1) / ns AS t0 FROM ba),
    zz AS (
      SELECT *, z1 + (z2 - z1) * t0 - 4 * sag * t0 * (1 - t0) AS za, z1 + (z2 - z1) * (t0 + 1.0::double / ns) - 4 * sag * (t0 + 1.0::double / ns) * (1 - t0 - 1.0::double / ns) AS zb FROM se
    )
    SELECT way_id, count(*) AS balls, round(sum(x1 + (x2 - x1) * t), 2) AS sum_x, round(sum(y1 + (y2 - y1) * t), 2) AS sum_y, round(sum(za + (zb - za) * (t - t0) * ns),
      2) AS sum_z FROM zz GROUP BY way_id""", base)


def lift_tag():
    u = F.col("user_id")
    return F.when(u % 4 == 0, "gondola").when(u % 4 == 1, "cable_car").when(u % 4 == 2, "chair_lift").otherwise("t-bar")


def lifts(spark, sf):
    """Every way as a lift: its points with pylon and foot_z."""
    named = points(spark, sf).withColumn("lift", tags.aerialway_class(lift_tag())).withColumn("foot_z", F.lit(100.0) + F.col("pos") * F.col("pos") % 37)
    return named.select("*", F.col("lift.line_class").alias("line_class"), F.col("lift.pylon").alias("pylon")).drop("lift")


LIFTS_SQL = """
, lf AS (
  SELECT lw.*, CASE WHEN user_id % 4 < 2 THEN 'cabin' ELSE 'chair' END AS line_class, CASE
    WHEN user_id % 4 < 2 THEN 'Pylon_AerialCab' ELSE 'Pylon_Aerialway' END AS pylon, 100.0::double + pos * pos % 37 AS foot_z FROM lw
)"""


def p24_aerialway_class(spark, sf):
    """Every seventh way is tagged as a station, which is no lift."""
    tag = F.when(F.col("user_id") % 7 == 0, "station").otherwise(lift_tag())
    found = points(spark, sf).where(tags.is_aerialway(tag)).select(tags.aerialway_class(tag).alias("lift"))
    return found.groupBy("lift.line_class", "lift.pylon").agg(F.count("*").alias("n"))


add("p24_aerialway_class", p24_aerialway_class, LIFTS_SQL + "SELECT line_class, pylon, count(*) AS n FROM lf WHERE user_id % 7 <> 0 GROUP BY ALL")


def w11_pitch(spark, sf):
    return net.with_pitch(net.placed(lifts(spark, sf))).where("placed").select("way_id", "pos", r4(F.col("pitch_deg")).alias("pitch_deg"))


add("w11_pitch", w11_pitch, LIFTS_SQL + """
, nb AS (
  SELECT *, lag(placed) OVER w AS pa, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(foot_z) OVER w AS az, lead(placed) OVER w AS pb, lead(x) OVER w AS bx,
    lead(y) OVER w AS by_, lead(foot_z) OVER w AS bz
  FROM lf WINDOW w AS (PARTITION BY way_id ORDER BY pos)
), df AS (
  SELECT way_id, pos, CASE WHEN pb THEN bz ELSE foot_z END - CASE WHEN pa THEN az ELSE foot_z END AS dz,
    sqrt((CASE WHEN pb THEN bx ELSE x END - CASE WHEN pa THEN ax ELSE x END) ** 2 + (CASE WHEN pb THEN by_ ELSE y END - CASE WHEN pa THEN ay ELSE y END) ** 2) AS run FROM nb WHERE placed
)
SELECT way_id, pos, round(CASE WHEN run < 1e-6 THEN 0 ELSE degrees(atan2(dz, run)) END, 4) + 0 AS pitch_deg FROM df""")


def _parts(placements):
    return placements.select("lod", "part", "model", *[c for c in ("way_id", "pos", "point_id") if c in placements.columns], *[r4(F.col(c)).alias(c) for c in ("foot_z", "yaw_deg", "spin_deg", "tilt_deg")])


def g11_power_placements(spark, sf):
    return _parts(net.power_placements(drawn(spark, sf)))


add("g11_power_placements", g11_power_placements, """
SELECT lod, 'pylon' AS part, 'Pylon_' || upper(left(kind, 1)) || substr(kind, 2) || CASE lod WHEN 1 THEN '_Low' ELSE '' END AS model, way_id, pos, foot_z, round(yaw_deg, 4) + 0 AS yaw_deg,
  0::DOUBLE AS spin_deg, 0::DOUBLE AS tilt_deg FROM yw JOIN lc USING (way_id), (VALUES (0), (1)) l(lod) WHERE placed AND power IN ('line', 'minor_line') AND coalesce(kv >= 1, TRUE) AND (lod = 0 OR kind <> 'small')""")


def g11_lift_placements(spark, sf):
    return _parts(net.lift_placements(lifts(spark, sf)))


add("g11_lift_placements", g11_lift_placements, LIFTS_SQL + f"""
, pt_ AS (SELECT lf.way_id, lf.pos, lf.pylon, lf.line_class, lf.foot_z, yw.yaw_deg - 90 AS yaw, pi_.pitch_deg FROM lf JOIN yw ON yw.way_id = lf.way_id AND yw.pos = lf.pos JOIN ({O["w11_pitch"]}) pi_ ON pi_.way_id = lf.way_id AND pi_.pos = lf.pos)
SELECT lod, part, CASE part WHEN 'pylon' THEN pylon ELSE pylon || '_Rollers' END AS model, way_id, pos, round(foot_z, 4) + 0 AS foot_z, round(yaw - floor(yaw / 360) * 360, 4) + 0 AS yaw_deg, 0::DOUBLE AS spin_deg,
  CASE part WHEN 'pylon' THEN 0 ELSE round(pitch_deg, 4) END::DOUBLE AS tilt_deg FROM pt_, (VALUES (0), (1)) l(lod), (VALUES ('pylon'), ('rollers')) p(part) WHERE part = 'pylon' OR line_class = 'chair'""")


def g11_turbine_placements(spark, sf):
    from terralith.operators import terrain
    from terralith.plans import place_queries as pl

    sites = pl.supports(spark, sf).where("kind = 'turbine'")
    feet = terrain.feet(sites, pl.triangles(spark, sf), ["patch_id", "point_id"], size=pl.CELL_M)
    placed = sites.join(feet, ["patch_id", "point_id"]).withColumnsRenamed({"px": "x", "py": "y"})
    return _parts(net.turbine_placements(placed, ["point_id"]))


def _turbines_sql() -> str:
    from terralith.plans import place_queries as pl

    return f"""{pl.POINTS_SQL}, {pl.TERRAIN_SQL},
fv AS (SELECT patch_id, point_id, greatest(-2879, least(2879, px + unnest([0, 4, -4, 0, 0]))) AS px, greatest(-2879, least(2879, py + unnest([0, 0, 0, 4, -4]))) AS py FROM pt WHERE kind = 'turbine'), {pl.elevation_sql('fv', 'zz')},
ft AS (SELECT point_id, round(coalesce(min(z) - 0.3, 0), 4) + 0 AS foot_z FROM zz GROUP BY point_id)
SELECT lod, part, CASE part WHEN 'tower' THEN 'Wind_Turbine_Tower' ELSE 'Wind_Turbine_Blades' END || CASE lod WHEN 1 THEN '_Low' ELSE '' END AS model, point_id, foot_z, 0::DOUBLE AS yaw_deg,
  CASE part WHEN 'tower' THEN 0 ELSE mod(('0x' || right(sha256(point_id || 'spin'), 8))::BIGINT & 2147483647, 3600) / 10 END::DOUBLE AS spin_deg, 0::DOUBLE AS tilt_deg
FROM ft JOIN pt USING (point_id), (VALUES (0), (1)) l(lod), (VALUES ('tower'), ('blades')) p(part) WHERE abs(px) <= 2880 AND abs(py) <= 2880"""



def w13_g15_carriers(spark, sf):
    found = net.carriers(lifts(spark, sf))
    return found.groupBy("way_id", "run_id", "leg").agg(F.count("*").alias("items"), F.max("item").alias("last_item"), *[F.round(F.sum(c), 2).alias(f"sum_{c}") for c in "xyz"])


add("w13_g15_carriers", w13_g15_carriers, LIFTS_SQL + """
, yl AS (SELECT lf.*, radians(raw - 90) AS yaw FROM lf JOIN yw0 USING (way_id, pos)
), rn AS (SELECT *, sum(CASE WHEN placed AND NOT coalesce(before, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) AS run_id FROM (SELECT *,
  lag(placed) OVER (PARTITION BY way_id ORDER BY pos) AS before FROM yl)
), rp AS (SELECT * FROM rn WHERE placed QUALIFY count(*) OVER (PARTITION BY way_id, run_id) > 1
), lg AS (SELECT *, unnest([0, 1]) AS leg, unnest([1, -1]) * CASE WHEN pylon = 'Pylon_AerialCab' THEN 7.678::double ELSE 2.81 END AS across, CASE
  WHEN pylon = 'Pylon_AerialCab' THEN 22.589::double ELSE 8.2 END AS up,
    CASE WHEN pylon = 'Pylon_AerialCab' THEN 77.5::double ELSE 15 END AS spacing, unnest([pos, -pos]) AS nth FROM rp
), cx AS (SELECT way_id, run_id, leg, nth, spacing, x - across * sin(yaw) AS x, y + across * cos(yaw) AS y, foot_z + up AS z FROM lg
), cn AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM cx WINDOW w AS (PARTITION BY way_id, run_id, leg ORDER BY nth)
), cl AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2 + (z2 - z) ** 2) AS len FROM cn WHERE x2 IS NOT NULL
), cm AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY way_id, run_id ORDER BY leg, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_m FROM cl WHERE len >= 1e-6
), it AS (SELECT *, unnest(generate_series(ceil(round(from_m / spacing, 9))::BIGINT, ceil(round((from_m + len) / spacing, 9))::BIGINT - 1)) AS item FROM cm
), ip AS (SELECT *, (item * spacing - from_m) / len AS t FROM it)
SELECT way_id, run_id::BIGINT AS run_id, leg, count(*) AS items, max(item) AS last_item, round(sum(x + (x2 - x) * t), 2) AS sum_x, round(sum(y + (y2 - y) * t),
  2) AS sum_y, round(sum(z + (z2 - z) * t), 2) AS sum_z
FROM ip GROUP BY ALL""")
