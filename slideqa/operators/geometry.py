"""Tiling of slides, virtual variants, bounding boxes, and which tiles a region covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name, column half, row half, flipped vertically, flipped horizontally.
VARIANTS = [
    ("original", None, None, False, False),
    ("tl", 0, 0, False, False), ("tr", 1, 0, False, False), ("bl", 0, 1, False, False), ("br", 1, 1, False, False),
    ("tl_flip", 0, 0, True, True), ("tr_flip", 1, 0, True, False), ("bl_flip", 0, 1, False, True), ("br_flip", 1, 1, True, True),
]
#: Pixels of a region by magnification.
REGION_PIXELS = {10: 2048, 20: 1024}


def tile_grid(slides: DataFrame, patch: int = 512, grid: int = 3) -> DataFrame:
    """Adds packs_x, packs_y, patch_w, patch_h, stride_x, stride_y. A pack is grid x grid patches."""
    out = slides.withColumns({"packs_x": F.expr(f"greatest(1, width div {patch * grid})"), "packs_y": F.expr(f"greatest(1, height div {patch * grid})")})
    out = out.withColumns({"patch_w": F.expr(f"width div (packs_x * {grid})"), "patch_h": F.expr(f"height div (packs_y * {grid})")})
    return out.withColumns({"stride_x": F.col("patch_w") * grid, "stride_y": F.col("patch_h") * grid})


def packs(grid: DataFrame) -> DataFrame:
    """A row per pack, row-major: pack_idx, pack_x_idx, pack_y_idx, x, y."""
    rows = grid.withColumn("pack_y_idx", F.explode(F.expr("sequence(0, packs_y - 1)"))).withColumn("pack_x_idx", F.explode(F.expr("sequence(0, packs_x - 1)")))
    return rows.withColumns({"pack_idx": F.expr("pack_y_idx * packs_x + pack_x_idx"), "x": F.expr("pack_x_idx * stride_x"), "y": F.expr("pack_y_idx * stride_y")})


def pack_patches(pack_rows: DataFrame, grid: int = 3) -> DataFrame:
    """A row per patch of each pack: row, col, patch_x, patch_y."""
    rows = pack_rows.withColumn("row", F.explode(F.expr(f"sequence(0, {grid - 1})"))).withColumn("col", F.explode(F.expr(f"sequence(0, {grid - 1})")))
    return rows.withColumns({"patch_x": F.expr("x + col * patch_w"), "patch_y": F.expr("y + row * patch_h")})


def tissue_packs(patch_stats: DataFrame, white: float = 240.0, margin: int = 0) -> DataFrame:
    """slide_id, pack_x_idx, pack_y_idx of packs of which no more than half (+ margin) is white."""
    out = patch_stats.groupBy("slide_id", "pack_x_idx", "pack_y_idx").agg(F.count_if(F.col("mean_grey") > white).alias("white"), F.count("*").alias("patches"))
    return out.where(F.col("white") <= F.col("patches") / 2 + margin)


def tissue_share(regions: DataFrame, histogram: str = "histogram", background: int = 220, least: float = 0.2) -> DataFrame:
    """Adds tissue_ratio and is_tissue from a 256-bin grey histogram (array)."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    dark = F.aggregate(F.slice(histogram, 1, background), F.lit(0).cast("long"), lambda a, x: a + x)
    out = regions.withColumn("tissue_ratio", F.coalesce(F.try_divide(dark, total), F.lit(0.0)))
    return out.withColumn("is_tissue", F.col("tissue_ratio") >= least)


def virtual_variants(slides: DataFrame) -> DataFrame:
    """Nine rows per slide: variant, crop_x, crop_y, crop_w, crop_h, flip_v, flip_h."""
    literal = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(c).cast("int").alias("qx"), F.lit(r).cast("int").alias("qy"), F.lit(v).alias("flip_v"), F.lit(h).alias("flip_h")) for n, c, r, v, h in VARIANTS])
    rows = slides.select("*", F.inline(literal))
    half = lambda q, size: F.when(F.col(q).isNull(), 0).otherwise(F.col(q) * F.expr(f"{size} div 2"))
    span = lambda q, size: F.when(F.col(q).isNull(), F.col(size)).otherwise(F.expr(f"{size} div 2"))
    return rows.withColumns({"crop_x": half("qx", "width"), "crop_y": half("qy", "height"), "crop_w": span("qx", "width"), "crop_h": span("qy", "height")}).drop("qx", "qy")


def source_point(points: DataFrame) -> DataFrame:
    """Adds source_x, source_y: where (x, y) of a variant, for a read of size w x h, lies on the slide."""
    x = F.when(F.col("flip_h"), F.col("crop_w") - F.col("x") - F.col("w")).otherwise(F.col("x"))
    y = F.when(F.col("flip_v"), F.col("crop_h") - F.col("y") - F.col("h")).otherwise(F.col("y"))
    return points.withColumns({"source_x": x + F.col("crop_x"), "source_y": y + F.col("crop_y")})


def selected_clusters(geometry: DataFrame, least: int = 100, inclusive: bool = False, radius: float = 1024.0) -> DataFrame:
    """Clusters of more than ``least`` patches (or as many); a null or zero radius becomes the default."""
    keep = F.col("count") >= least if inclusive else F.col("count") > least
    return geometry.where(keep).withColumn("radius", F.coalesce(F.when(F.col("radius") != 0, F.col("radius")), F.lit(radius)))


def _clipped(rows: DataFrame, x0, y0, x1, y1) -> DataFrame:
    out = rows.withColumns({"x0": x0, "y0": y0}).withColumns({"x1": F.least(F.col("width"), x1), "y1": F.least(F.col("height"), y1)})
    return out.where("x1 > x0 and y1 > y0")


def cluster_windows(slides: DataFrame, clusters: DataFrame, scale: float = 1.0) -> DataFrame:
    """slide_id, cluster_id, x0, y0, x1, y1: centre +- scale * radius, inside the slide."""
    r = (F.col("radius") * scale).cast("long")
    rows = clusters.join(slides, "slide_id").withColumns({"cx": F.col("center_x").cast("long"), "cy": F.col("center_y").cast("long"), "r": r})
    zero = F.lit(0).cast("long")
    return _clipped(rows, F.greatest(zero, F.expr("cx - r")), F.greatest(zero, F.expr("cy - r")), F.expr("cx + r"), F.expr("cy + r"))


def boxes(slides: DataFrame, geometry: DataFrame, least: int = 100, radius: float = 1024.0, regions: dict[int, int] | None = None) -> DataFrame:
    """image_name, type (wsi, cluster, roi), slide_id, cluster_id, magnification, x0, y0, x1, y1."""
    names = ["image_name", "type", "slide_id", "cluster_id", "magnification", "x0", "y0", "x1", "y1"]
    null, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    whole = slides.select(F.concat("slide_id", F.lit(".png")).alias("image_name"), F.lit("wsi").alias("type"), "slide_id", null.alias("cluster_id"), null.alias("magnification"), zero.alias("x0"), zero.alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    shown = cluster_windows(slides, selected_clusters(geometry, least, radius=radius))
    cluster = shown.withColumns({"image_name": F.concat("slide_id", F.lit("_"), "cluster_id", F.lit(".png")), "type": F.lit("cluster"), "magnification": null}).select(*names)
    sizes = F.array(*[F.struct(F.lit(f"{m}x").alias("magnification"), F.lit(p).cast("long").alias("size")) for m, p in (regions or REGION_PIXELS).items()])
    rows = shown.drop("x0", "y0", "x1", "y1").select("*", F.inline(sizes))
    roi = _clipped(rows, F.greatest(zero, F.expr("cx - size div 2")), F.greatest(zero, F.expr("cy - size div 2")), F.expr("x0 + size"), F.expr("y0 + size"))
    roi = roi.withColumns({"image_name": F.concat("slide_id", F.lit("_"), "cluster_id", F.lit("_"), "magnification", F.lit(".png")), "type": F.lit("roi")}).select(*names)
    return whole.unionByName(cluster).unionByName(roi)


def covering_packs(regions: DataFrame, grid: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """region_id with each pack it meets (half-open rectangles). The grid is regular, so the range of pack
    numbers is arithmetic; valid packs, if given, are met by equality. regions: slide_id, region_id, x0..y1."""
    on = grid.select("slide_id", "packs_x", "packs_y", "stride_x", "stride_y")
    rows = regions.join(on, "slide_id")
    low = lambda v, s: F.expr(f"greatest(0, cast(floor({v} / {s}) as int))")
    high = lambda v, s, n: F.expr(f"least(cast({n} - 1 as int), cast(ceil({v} / {s}) - 1 as int))")
    rows = rows.withColumns({"a": low("x0", "stride_x"), "b": high("x1", "stride_x", "packs_x"), "c": low("y0", "stride_y"), "d": high("y1", "stride_y", "packs_y")}).where("a <= b and c <= d and x1 > x0 and y1 > y0")
    rows = rows.withColumn("pack_y_idx", F.explode(F.expr("sequence(c, d)"))).withColumn("pack_x_idx", F.explode(F.expr("sequence(a, b)")))
    out = rows.select("slide_id", "region_id", "pack_x_idx", "pack_y_idx", F.expr("pack_y_idx * packs_x + pack_x_idx").alias("pack_idx"))
    return out if valid is None else out.join(valid.select("slide_id", "pack_x_idx", "pack_y_idx").distinct(), ["slide_id", "pack_x_idx", "pack_y_idx"], "left_semi")


def uncovered_regions(regions: DataFrame, covered: DataFrame) -> DataFrame:
    return regions.join(covered, ["slide_id", "region_id"], "left_anti")


def near_pairs(patches: DataFrame, radius: float) -> DataFrame:
    """slide_id, a, b, distance of patches of one slide at most ``radius`` apart, both directions, without
    self. Each patch looks into the nine cells around its own, so only neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / radius)
    left = patches.select("slide_id", F.col("patch_idx").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("i"), cell("y").alias("j"))
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = left.select("slide_id", "a", "ax", "ay", F.inline(steps), "i", "j").withColumns({"i": F.col("i") + F.col("di"), "j": F.col("j") + F.col("dj")}).drop("di", "dj")
    right = patches.select("slide_id", F.col("patch_idx").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("i"), cell("y").alias("j"))
    distance = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, ["slide_id", "i", "j"]).where("a <> b").withColumn("distance", distance).where(F.col("distance") <= radius).select("slide_id", "a", "b", "distance")


def nearest_patch(patches: DataFrame, points: DataFrame) -> DataFrame:
    """slide_id, point_id, patch_idx: the patch nearest to each point, the lowest number on ties."""
    d = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    met = patches.join(points, "slide_id").groupBy("slide_id", "point_id").agg(F.min(F.struct(d.alias("d"), "patch_idx")).alias("m"))
    return met.select("slide_id", "point_id", F.col("m.patch_idx").alias("patch_idx"))


def flattened_geometry(rows: DataFrame, value: str = "value") -> DataFrame:
    """Geometry JSON {slide: {cluster: {...}}}, or one level deeper, to rows of clusters."""
    kind = "map<string,map<string,string>>"
    one = rows.select(F.explode(F.from_json(value, kind)).alias("slide_id", "node")).select("slide_id", F.explode("node").alias("cluster_id", "json"))
    fields = "center_x double, center_y double, radius double, count int"
    flat = F.get_json_object("json", "$.count").isNotNull() | F.get_json_object("json", "$.center_x").isNotNull()
    direct = F.when(flat, F.array(F.struct(F.col("cluster_id").alias("key"), F.col("json").alias("value"))))
    deep = F.filter(F.map_entries(F.from_json("json", "map<string,string>")), lambda e: F.get_json_object(e["value"], "$.count").isNotNull() | F.get_json_object(e["value"], "$.center_x").isNotNull())
    out = one.select("slide_id", F.inline(F.coalesce(direct, deep)))
    return out.select("slide_id", F.col("key").alias("cluster_id"), F.from_json("value", fields).alias("g")).select("slide_id", "cluster_id", "g.*")
