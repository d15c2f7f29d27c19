"""Airports, point features, and merging a second source of footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import geo, kernels, rings, tags
from terralith.operators import elements
from terralith.shared import written

# How good an airport's source is, and lengths.
SOURCE_RANK = {"runway": 3, "runway_disused": 2, "aerodrome": 1}
DEFAULT_RUNWAY_M, ZONE_MARGIN_M, SHORTEST_M, AERODROME_ZONE_M = 1500.0, 458.0, 50.0, 750.0
NEAR_M, CELL_DEG = 5000.0, 0.002


def source_rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == name, rank) for name, rank in SOURCE_RANK.items()], F.lit(0))


def upsert_airports(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with what was found: new names, and known ones only from a better source."""
    both = registry.withColumn("known", F.lit(0)).unionByName(found.withColumn("known", F.lit(1)))
    first = Window.partitionBy("name").orderBy(F.desc(source_rank(F.col("source"))), "known", F.desc("length_m"))
    return both.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "known")


def merged_airports(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Both tables (name .. source, version, patch_id) with one entry a name: the best source, then the earliest version, the first patch, the longest.

    What an upsert in order of the versions would leave, but the same in whatever order tables are merged, and however often.
    """
    first = Window.partitionBy("name").orderBy(F.desc(source_rank(F.col("source"))), "version", "patch_id", F.desc("length_m"), "lat", "lon")
    both = registry.unionByName(found).where("name IS NOT NULL")
    return both.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def extract_airports(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(patch_id, name, length_m, lat, lon, source) of a map's aerodromes, and of its runways by their names (or refs)."""
    named = F.coalesce(F.col("tags")["name"], F.col("tags")["ref"], F.lit("airport"))
    aerodrome = nodes.where(elements.is_aerodrome(F.col("tags"))).select("patch_id", named.alias("name"), F.lit(DEFAULT_RUNWAY_M).alias("length_m"), "lat", "lon", F.lit("aerodrome").alias("source"))
    runways = ways.where(elements.is_runway(F.col("tags")))
    points = elements.way_points(runways, nodes).groupBy("patch_id", "way_id").agg(
        F.min_by(F.struct("lat", "lon"), "pos").alias("a"), F.max_by(F.struct("lat", "lon"), "pos").alias("b"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
    metres = runway_length(F.col("tags")["length"], F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    source = F.when(elements.is_disused(F.col("tags")), "runway_disused").otherwise("runway")
    runway = runways.join(points, ["patch_id", "way_id"]).select("patch_id", named.alias("name"), metres.alias("length_m"), "lat", "lon", source.alias("source"))
    return aerodrome.unionByName(runway.where(F.col("length_m") >= SHORTEST_M))


def longest_runways(runways: DataFrame) -> DataFrame:
    """Per name the longest active runway, or else the longest disused one; without any, the default length."""
    first = Window.partitionBy("name").orderBy(F.col("source") == "aerodrome", F.col("source") != "runway", F.desc("length_m"))
    best = runways.where(F.col("length_m") >= SHORTEST_M).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return best.select("name", F.when(F.col("source") == "aerodrome", DEFAULT_RUNWAY_M).otherwise(F.col("length_m")).alias("length_m"), "source")


def airport_zones(airports: DataFrame) -> DataFrame:
    return airports.withColumn("zone_m", F.col("length_m") / 2 + ZONE_MARGIN_M)


def best_zone_source(zones: DataFrame) -> DataFrame:
    """Per patch only the zones of its best source: registry, runways, aerodromes (priority 0, 1, 2)."""
    best = Window.partitionBy("patch_id").orderBy("priority")
    return zones.withColumn("r", F.dense_rank().over(best)).where("r = 1").drop("r")


def in_any_zone(spans: DataFrame, zones: DataFrame, cell: float = 1000.0) -> DataFrame:
    """The spans (patch_id, mx, my) whose middle lies in a zone (patch_id, zx, zy, zone_m) of their patch.

    A zone is listed in every cell that its box touches, a span in its own.
    """
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("zone_m")) / cell).cast("int"), F.floor((F.col(c) + F.col("zone_m")) / cell).cast("int")))
    wide = zones.select("patch_id", "zx", "zy", "zone_m", cells("zx").alias("gx")).select("*", cells("zy").alias("gy"))
    own = spans.withColumns({"gx": F.floor(F.col("mx") / cell).cast("int"), "gy": F.floor(F.col("my") / cell).cast("int")})
    same = (own["patch_id"] == wide["patch_id"]) & (own["gx"] == wide["gx"]) & (own["gy"] == wide["gy"])
    near = F.sqrt(F.pow(own["mx"] - wide["zx"], 2) + F.pow(own["my"] - wide["zy"], 2)) <= wide["zone_m"]
    return own.join(wide, same & near, "left_semi").drop("gx", "gy")


def runway_length(tag: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres as tagged, or else between a runway's ends."""
    tagged = tags.number(F.replace(F.lower(tag), F.lit("m"), F.lit("")))
    return F.coalesce(tagged, geo.distance_m(lat1, lon1, lat2, lon2))


def airports_in_patches(airports: DataFrame, patches: DataFrame, half: float = 2880.0, cell_deg: float = 0.1) -> DataFrame:
    """Airports (lat, lon) projected into each patch (patch_id, zone, tx, ty, lat_min .. lon_max) in whose square they lie.

    They meet in cells of degrees that the patch's box touches. A place that several airports or patches have is projected once.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell_deg).cast("int"), F.floor(F.col(high) / cell_deg).cast("int")))
    frame, place = ["zone", "tx", "ty", "lat_min", "lat_max", "lon_min", "lon_max"], ["lat", "lon"]
    frames = patches.select(*frame).distinct().select("*", cells("lat_min", "lat_max").alias("gy")).select("*", cells("lon_min", "lon_max").alias("gx"))
    sites = airports.select(*place).distinct().withColumns({"gy": F.floor(F.col("lat") / cell_deg).cast("int"), "gx": F.floor(F.col("lon") / cell_deg).cast("int")})
    # The generator keeps the projection from being computed once for each use of it.
    placed = sites.join(frames, ["gx", "gy"]).select(*place, *frame, F.inline(F.array(geo.project_utm(F.col("lat"), F.col("lon"), F.col("zone"), F.col("tx"), F.col("ty")))))
    inside = placed.where((F.abs("x") <= half) & (F.abs("y") <= half))
    whole = patches.select("patch_id", *frame).join(inside, frame).select("patch_id", *place, "x", "y")
    return airports.join(whole, place).select("patch_id", *airports.columns, "x", "y")


def merged_box(patches: DataFrame, by: list[str]) -> DataFrame:
    """The box around the patches (lat_min .. lon_max) of each group."""
    return patches.groupBy(*by).agg(F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"))


def runway_names(runways: DataFrame, aerodromes: DataFrame, cell_deg: float = 0.1) -> DataFrame:
    """runway_id and name: the smallest aerodrome box around it, else the nearest centre within 5 km, else its ref, else airport.

    Runways (runway_id, lat, lon, ref) and aerodromes (name, box, centre) meet in
    cells: an aerodrome is listed in every cell its box or its 5 km circle touches.
    What a place is called depends on nothing but the place, and of aerodromes with one box and centre only the first name
    can win, so places meet boxes, each once, however many runways and aerodromes have them.
    """
    reach = NEAR_M / 111320.0 * 2.0
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell_deg).cast("int"), F.floor(high / cell_deg).cast("int")))
    boxes = aerodromes.groupBy("lat_min", "lat_max", "lon_min", "lon_max", "c_lat", "c_lon").agg(F.min("name").alias("name"))
    wide = boxes.select("*", cells(F.least(F.col("lat_min"), F.col("c_lat") - reach), F.greatest(F.col("lat_max"), F.col("c_lat") + reach)).alias("gy"))
    wide = wide.select("*", cells(F.least(F.col("lon_min"), F.col("c_lon") - reach * 2), F.greatest(F.col("lon_max"), F.col("c_lon") + reach * 2)).alias("gx"))
    sites = runways.select("lat", "lon").distinct().withColumns({"gy": F.floor(F.col("lat") / cell_deg).cast("int"), "gx": F.floor(F.col("lon") / cell_deg).cast("int")})
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    metres = geo.distance_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    box = (F.col("lat_max") - F.col("lat_min")) * (F.col("lon_max") - F.col("lon_min"))
    met = sites.join(wide, ["gx", "gy"]).groupBy("lat", "lon").agg(
        F.min_by("name", F.when(inside, F.struct(box, "name"))).alias("around"), F.min_by("name", F.when(metres <= NEAR_M, F.struct(metres, "name"))).alias("near")
    )
    return runways.join(met, ["lat", "lon"], "left").select("runway_id", F.coalesce("around", "near", "ref", F.lit("airport")).alias("name"))


def point_model(kind: Column, height: Column, material: Column) -> Column:
    """(model, scale) of a chimney or mast; a height of 30 m is assumed where none is known."""
    metres = F.coalesce(height, F.lit(30.0))
    big_chimney = (F.coalesce(material, F.lit("")) != "brick") & (metres > 30)
    chimney = F.when(big_chimney, "chimney_big").otherwise("chimney_small")
    mast = F.when(metres > 100, "transmitter_big").otherwise("transmitter_small")
    native = F.when(kind == "chimney", F.when(big_chimney, 100.0).otherwise(30.0)).otherwise(F.when(metres > 100, 200.0).otherwise(50.0))
    return F.struct(F.when(kind == "chimney", chimney).otherwise(mast).alias("model"), (metres / native).alias("scale"))


def first_fit(conflicts: DataFrame) -> DataFrame:
    """(way): those that a pass in order turns down, which takes each way that no way taken before conflicts with.

    ``conflicts`` has (before, way), before coming first. Ways are settled in rounds, all at
    once: a way is taken as soon as no open way before it conflicts, and turns down those
    after it. A round settles at least the first way of every chain, so there are half as many
    rounds as the longest chain has ways; each is written, and works on what is still open.
    """
    open_, turned_down = written(conflicts.select("before", "way").distinct(), "conflicts"), None
    nothing = open_.select("way").limit(0)
    while not open_.isEmpty():
        taken = open_.select("before").distinct().join(open_.select(F.col("way").alias("before")), "before", "left_anti")
        gone = written(open_.join(taken, "before", "left_semi").select("way").distinct(), "turned-down")
        turned_down = gone if turned_down is None else turned_down.unionByName(gone)
        left = open_.join(taken, "before", "left_anti").join(gone, "way", "left_anti").join(gone.withColumnRenamed("way", "before"), "before", "left_anti")
        open_ = written(left.select("before", "way"), "conflicts")
    return nothing if turned_down is None else turned_down


def quiet_ways(ways: DataFrame, nodes: DataFrame, cell: float = 50.0, first: int = 10_000) -> DataFrame:
    """Ways (patch_id, way_id, nth, ring) that a pass in the order of nth accepts: those around no accepted node
    (patch_id, x, y) and around the centre of no way accepted before.

    A way that isn't accepted suppresses nothing, so chains are settled in order (``first_fit``);
    nth is unique in a patch. Ways are listed in the cells that their boxes touch, points in their own.

    The order is cut into stretches, the first of about ``first`` ways, each as long as all before it. A stretch
    loses its ways around centres accepted before it, of which there are few where many ways lie over each other;
    only what is left meets itself, so pairs that an earlier way settles are never listed.
    """
    def listed(df: DataFrame) -> DataFrame:
        box = df.select("patch_id", "way_id", "nth", "ring", F.inline(F.array(F.struct(rings.bbox(F.col("ring")).alias("box")))))
        at = lambda side: F.floor(F.col(f"box.{side}") / cell).cast("int")
        wide = box.select("*", F.explode(F.sequence(at("min_x"), at("max_x"))).alias("gx"))
        return wide.select("*", F.explode(F.sequence(at("min_y"), at("max_y"))).alias("gy"))

    def celled(points: DataFrame) -> DataFrame:
        return points.withColumns({"gx": F.floor(F.col("x") / cell).cast("int"), "gy": F.floor(F.col("y") / cell).cast("int")})

    key, cells = ["patch_id", "way_id"], ["patch_id", "gx", "gy"]
    around = rings.inside_winding(F.col("ring"), F.col("x"), F.col("y"))
    centres = lambda df, name: celled(df.select("patch_id", F.col("nth").alias(name), rings.closed_mean(F.col("ring")).alias("c")).select("patch_id", name, "c.x", "c.y"))
    here = listed(ways).join(celled(nodes.select("patch_id", "x", "y").distinct()), cells).where(around).select(*key).distinct()
    free = written(ways.join(here, key, "left_anti"), "free-ways")
    total, shares = free.count(), []
    while first << len(shares) < total:
        shares.append((first << len(shares)) / total)
    bounds = sorted(set(free.agg(F.percentile_approx("nth", shares)).first()[0])) if shares else []
    accepted = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        own = free if low is None else free.where(F.col("nth") > low)
        own = own if high is None else own.where(F.col("nth") <= high)
        if accepted is not None:
            gone = listed(own).join(centres(accepted, "before"), cells).where(around).select(*key).distinct()
            own = own.join(gone, key, "left_anti")
        own = written(own, "open-ways")
        met = listed(own).join(centres(own, "before"), cells).where((F.col("before") < F.col("nth")) & around)
        later = first_fit(met.select(F.struct("patch_id", F.col("before").alias("nth")).alias("before"), F.struct("patch_id", "nth").alias("way")))
        own = written(own.join(later.select("way.patch_id", "way.nth"), ["patch_id", "nth"], "left_anti").select(*ways.columns), "quiet-ways")
        accepted = own if accepted is None else accepted.unionByName(own)
    return accepted


def overlapping(base: DataFrame, other: DataFrame, cell: float = 50.0, first: int = 4, more: int = 8) -> DataFrame:
    """(patch_id, other_id) of the footprints of ``other`` that overlap one of ``base``: boxes meet, and a vertex or the centre of one lies in the other.

    Both sides are (patch_id, osm_id, outer). They meet in the cells that their boxes touch, and a pair is tested
    in one of them only, that of the lower corner of what their boxes have in common.

    One overlap is enough, so where many footprints lie over each other not all pairs are tested: a round has the next
    of every cell's base footprints, at first ``first``, then ``more`` times as many, and those of ``other`` without an
    overlap so far. The rounds go through all base footprints of a cell.
    """
    def celled(df: DataFrame, name: str) -> DataFrame:
        box = df.select("patch_id", F.col("osm_id").alias(f"{name}_id"), F.col("outer").alias(f"{name}_ring"), F.inline(F.array(F.struct(rings.bbox(F.col("outer")).alias(f"{name}_box")))))
        at = lambda side: F.floor(F.col(f"{name}_box.{side}") / cell).cast("int")
        wide = box.select("*", F.explode(F.sequence(at("min_x"), at("max_x"))).alias("gx"))
        return wide.select("*", F.explode(F.sequence(at("min_y"), at("max_y"))).alias("gy"))

    cells = ["patch_id", "gx", "gy"]
    nth = F.row_number().over(Window.partitionBy(*cells).orderBy(F.xxhash64("b_id"))).alias("nth")
    placed, open_, found = written(celled(base, "b").select("*", nth), "base-cells"), celled(other, "o"), None
    boxes = (F.col("b_box.min_x") <= F.col("o_box.max_x")) & (F.col("b_box.max_x") >= F.col("o_box.min_x")) & (F.col("b_box.min_y") <= F.col("o_box.max_y")) & (F.col("b_box.max_y") >= F.col("o_box.min_y"))
    corner = lambda axis: F.floor(F.greatest(f"b_box.min_{axis}", f"o_box.min_{axis}") / cell).cast("int")
    once = (F.col("gx") == corner("x")) & (F.col("gy") == corner("y"))
    most, low, high = placed.agg(F.max("nth")).first()[0] or 0, 0, first
    while True:
        met = placed.where((F.col("nth") > low) & (F.col("nth") <= high)).join(open_, cells)
        hit = met.where(boxes & once).select("patch_id", F.col("o_id").alias("other_id"), kernels.rings_overlap("b_ring", "o_ring").alias("hit")).where("hit")
        # A footprint that overlaps several of the base is found with each.
        hit = hit.groupBy("patch_id", "other_id").agg(F.lit(1).alias("one")).drop("one")
        last = high >= most
        hit = hit if last and found is None else written(hit, "overlapping")
        found = hit if found is None else found.unionByName(hit)
        if last:
            return found
        gone = hit.select(F.col("patch_id").alias("at"), "other_id")
        open_ = written(open_.join(gone, (F.col("patch_id") == F.col("at")) & (F.col("o_id") == F.col("other_id")), "left_anti"), "open")
        low, high = high, high * more


def merged_sources(base: DataFrame, other: DataFrame) -> DataFrame:
    """``base`` and the footprints of ``other`` that overlap none of it, tagged by source, the added ones with fresh negative ids per patch."""
    gone = overlapping(base, other)
    added = other.join(gone, (other["patch_id"] == gone["patch_id"]) & (other["osm_id"] == gone["other_id"]), "left_anti")
    nth = F.row_number().over(Window.partitionBy("patch_id").orderBy(F.col("osm_id").try_cast("bigint"), "osm_id"))
    return base.select("patch_id", "osm_id", "outer", F.lit("base").alias("source")).unionByName(added.select("patch_id", (-nth).cast("string").alias("osm_id"), "outer", F.lit("ml").alias("source")))


def tiles_needed(boxes: DataFrame, index: DataFrame) -> DataFrame:
    """(patch_id, quadkey, urls) of the tiles that the corners and the centre of a patch lie in; no urls where the index has none."""
    at = lambda lat, lon: geo.quadkey(lat, lon)
    s, n, w, e = (F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    keys = F.array_distinct(F.array(at(s, w), at(s, e), at(n, w), at(n, e), at((s + n) / 2, (w + e) / 2)))
    return boxes.select("patch_id", F.explode(keys).alias("quadkey")).join(index, "quadkey", "left").select("patch_id", "quadkey", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def added_only(known: DataFrame, side: DataFrame, key: list[str]) -> DataFrame:
    """``known`` and the rows of ``side`` whose key it doesn't have."""
    return known.unionByName(side.join(known.select(*key), key, "left_anti"))
