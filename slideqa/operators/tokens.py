"""Token sequences of slides: one global token, then packs of patch tokens and a summary token.

Random choices are orders by a hash of (seed, slide, number), so they don't depend on partitions, and repeat. The k
first of a slide are found without sorting it: a histogram of the hashes tells in which bucket the k-th stands, only
that bucket is ordered, and the k-th's place is then a threshold a slide, held against each row where it is. Embeddings
pass no window. A choice takes any ``draw`` of a long from a seed and columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACK = 9
LONGEST = 200_000
#: Groups whose thresholds, some 50 bytes each, are sent to all tasks.
CUTS = 100_000


def seeded(seed: int, *parts: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def portable(seed: int, *parts: str | Column) -> Column:
    """A draw that other systems can repeat: the first 60 bits of the MD5 of seed and parts, joined by |."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


Draw = Callable[..., Column]


def thresholds(rows: DataFrame, keep: Callable[[Column], Column], by: str = "slide_id") -> DataFrame:
    """by, n and cut: the keep(n)-th smallest order of each group's n rows (by, order: a struct that begins with a
    long, no two alike). A group without any to keep has no row, one that keeps all has a null cut."""
    bucket = F.shiftright(F.col("order")[rows.schema["order"].dataType.names[0]], 52)
    rows = rows.select(by, "order", bucket.alias("_bucket"))
    counts = rows.groupBy(by, "_bucket").agg(F.count("*").alias("c")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_bucket", "c"))).alias("h"), F.sum("c").alias("n"))
    state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("rank"))

    def step(s: Column, x: Column) -> Column:
        here = s["bucket"].isNull() & (s["seen"] + x["c"] >= F.col("k"))
        return F.struct((s["seen"] + x["c"]).alias("seen"), F.when(here, x["_bucket"]).otherwise(s["bucket"]).alias("bucket"), F.when(here, F.col("k") - s["seen"]).otherwise(s["rank"]).alias("rank"))

    found = counts.withColumn("k", keep(F.col("n")).cast("long")).where("k > 0").withColumn("s", F.aggregate("h", state, step))
    found = found.select(by, "n", F.when(F.col("k") < F.col("n"), F.col("s.bucket")).alias("_bucket"), F.col("s.rank").alias("rank"))
    ordered = rows.join(found.where("_bucket is not null"), [by, "_bucket"]).withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("order")))
    cut = ordered.where("r = rank").select(by, "n", F.col("order").alias("cut"))
    return cut.unionByName(found.where("_bucket is null").select(by, "n", F.lit(None).cast(rows.schema["order"].dataType).alias("cut")))


def _within(rows: DataFrame, cuts: DataFrame, order: Column, by: str = "slide_id") -> DataFrame:
    """Adds within: whether the order is at or before its group's cut; null for groups without one."""
    cuts = cuts.select(by, "cut", F.lit(True).alias("_known"))
    cuts = F.broadcast(cuts) if cuts.limit(CUTS + 1).count() <= CUTS else cuts
    return rows.join(cuts, by, "left").withColumn("within", F.when(F.col("_known"), F.col("cut").isNull() | (order <= F.col("cut")))).drop("cut", "_known")


def _order(draw: Draw, seed: int, *parts: str) -> Column:
    return F.struct(draw(seed, "slide_id", *parts).alias("h"), *parts)


def with_roles(tokens: DataFrame, pack: int = PACK) -> DataFrame:
    """Adds seq_len, token_type (global, patch, summary), pack_idx (-1 for global), position. The last token
    of a short last pack is its summary."""
    out = tokens.join(tokens.groupBy("slide_id").agg(F.count("*").alias("seq_len")), "slide_id").select(*tokens.columns, "seq_len")
    rest = F.col("token_idx") - 1
    i, at = F.expr(f"(token_idx - 1) div {pack + 1}"), F.pmod(rest, F.lit(pack + 1))
    last = (at == pack) | (F.col("token_idx") == F.col("seq_len") - 1)
    kind = F.when(F.col("token_idx") == 0, "global").when(last, "summary").otherwise("patch")
    first = F.col("token_idx") == 0
    return out.withColumns({"token_type": kind, "pack_idx": F.when(first, -1).otherwise(i).cast("int"), "position": F.when(first, -1).otherwise(at).cast("int")})


def pack_ranges(roles: DataFrame) -> DataFrame:
    """slide_id, pack_idx, start, summary_idx, patches."""
    return roles.where("pack_idx >= 0").groupBy("slide_id", "pack_idx").agg(F.min("token_idx").alias("start"), F.max("token_idx").alias("summary_idx"), F.count_if(F.col("token_type") == "patch").alias("patches"))


def assembled(globals_: DataFrame, patches: DataFrame, summaries: DataFrame, pack: int = PACK, lone: bool = False) -> DataFrame:
    """slide_id, token_idx, embedding. Packs are numbered by their order; slides without packs have no tokens, or with
    lone their global one.
    globals_: slide_id, embedding; patches: slide_id, pack_idx, position, embedding; summaries: slide_id, pack_idx, embedding."""
    rank = summaries.select("slide_id", "pack_idx", (F.row_number().over(Window.partitionBy("slide_id").orderBy("pack_idx")) - 1).alias("rank"))
    first = (globals_ if lone else globals_.join(rank.select("slide_id").distinct(), "slide_id", "left_semi")).select("slide_id", F.lit(0).alias("token_idx"), "embedding")
    inner = patches.join(rank, ["slide_id", "pack_idx"]).select("slide_id", (1 + F.col("rank") * (pack + 1) + F.col("position")).alias("token_idx"), "embedding")
    last = summaries.join(rank, ["slide_id", "pack_idx"]).select("slide_id", (1 + F.col("rank") * (pack + 1) + pack).alias("token_idx"), "embedding")
    return first.unionByName(inner).unionByName(last)


def sequence_config(grid: DataFrame, valid: DataFrame, pack_grid: int = 3) -> DataFrame:
    """One row per slide: num_packs, num_patches (packs x grid), n_patch_tokens, seq_len; 0 without packs."""
    n = valid.groupBy("slide_id").agg(F.count("*").alias("n"))
    out = grid.join(n, "slide_id", "left").withColumn("num_packs", F.coalesce("n", F.lit(0)))
    return out.select("slide_id", "num_packs", (F.col("num_packs") * pack_grid).alias("num_patches"), (F.col("num_packs") * pack_grid**2).alias("n_patch_tokens"), F.when(F.col("num_packs") > 0, 1 + F.col("num_packs") * (pack_grid**2 + 1)).otherwise(0).alias("seq_len"))


def _kept(n: Column, ratio: float, most: int | None = None) -> Column:
    keep = F.greatest(F.lit(1), (n * F.lit(1 - ratio)).cast("int"))
    return keep if most is None else F.least(keep, F.lit(most))


def _packs(roles: DataFrame, pack: int) -> DataFrame:
    """slide_id, pack_idx of every pack, from the sequences' lengths."""
    lengths = roles.select("slide_id", "seq_len").distinct().where("seq_len > 1")
    return lengths.select("slide_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast((seq_len - 2) div {pack + 1} as int)"))).alias("pack_idx"))


def drop_packs(tokens: DataFrame, ratio: float, most: int = 800, seed: int = 0, pack: int = PACK, draw: Draw = seeded) -> DataFrame:
    """Keeps a random choice of each slide's packs in order, and the global token; slides of one pack or
    none stay whole."""
    roles, order = with_roles(tokens, pack), _order(draw, seed, "pack_idx")
    cuts = thresholds(_packs(with_roles(tokens.select("slide_id", "token_idx"), pack), pack).select("slide_id", order.alias("order")), lambda n: F.when(n <= 1, n).otherwise(_kept(n, ratio, most)))
    return _within(roles, cuts, order).where("pack_idx < 0 or within").select(*tokens.columns)


def mask_patches(tokens: DataFrame, ratio: float = 0.75, seed: int = 0, pack: int = PACK, draw: Draw = seeded) -> DataFrame:
    """Adds masked: all but a random choice of the patch tokens of each slide."""
    roles, order = with_roles(tokens, pack), _order(draw, seed, "token_idx")
    patches = with_roles(tokens.select("slide_id", "token_idx"), pack).where("token_type = 'patch'").select("slide_id", order.alias("order"))
    out = _within(roles, thresholds(patches, lambda n: _kept(n, ratio)), order)
    return out.withColumn("masked", (F.col("token_type") == "patch") & ~F.col("within")).drop("within")


def mask_packs(tokens: DataFrame, ratio: float = 0.75, seed: int = 0, pack: int = PACK, draw: Draw = seeded) -> DataFrame:
    """Adds masked: whole packs, but for a random choice; the global token stays visible."""
    roles, order = with_roles(tokens, pack), _order(draw, seed, "pack_idx")
    packs = _packs(with_roles(tokens.select("slide_id", "token_idx"), pack), pack).select("slide_id", order.alias("order"))
    out = _within(roles, thresholds(packs, lambda n: _kept(n, ratio)), order)
    return out.withColumn("masked", (F.col("pack_idx") >= 0) & F.coalesce(~F.col("within"), F.lit(False))).drop("within")


def _usable(summaries: DataFrame, lengths: DataFrame | None, longest: int) -> DataFrame:
    return summaries if lengths is None else summaries.join(lengths.where(F.col("seq_len") <= longest).select("slide_id"), "slide_id", "left_semi")


def adjacent_pairs(summaries: DataFrame, most: int | None = None, seed: int = 0, lengths: DataFrame | None = None, longest: int = LONGEST, draw: Draw = seeded) -> DataFrame:
    """slide_id, a, b of neighbouring summaries, both directions; ``most`` random ones per slide. summaries:
    slide_id, n (count of the slide's summaries). Slides longer than ``longest`` are left out."""
    rows = _usable(summaries, lengths, longest).where("n >= 2").select("slide_id", F.explode(F.expr("sequence(0, cast(n as int) - 2)")).alias("i"))
    pairs = rows.select("slide_id", F.inline(F.array(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b")), F.struct((F.col("i") + 1).alias("a"), F.col("i").alias("b")))))
    return _capped(pairs, most, seed, draw)


def self_pairs(summaries: DataFrame, most: int | None = None, seed: int = 0, lengths: DataFrame | None = None, longest: int = LONGEST, draw: Draw = seeded) -> DataFrame:
    rows = _usable(summaries, lengths, longest).where("n >= 2").select("slide_id", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("a"))
    return _capped(rows.withColumn("b", F.col("a")), most, seed, draw)


def mixed_pairs(summaries: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """Adjacent or self pairs, chosen per slide by its hash; kind tells which."""
    coin = F.pmod(seeded(seed, "slide_id"), F.lit(2))
    return adjacent_pairs(summaries.where(coin == 0), most, seed).withColumn("kind", F.lit("adjacent")).unionByName(self_pairs(summaries.where(coin == 1), most, seed).withColumn("kind", F.lit("noise")))


def _capped(pairs: DataFrame, most: int | None, seed: int, draw: Draw = seeded) -> DataFrame:
    if most is None:
        return pairs
    order = _order(draw, seed, "a", "b")
    cuts = thresholds(pairs.select("slide_id", order.alias("order")), lambda n: F.least(n, F.lit(most)))
    return _within(pairs, cuts, order).where("within").drop("within")


def add_noise(rows: DataFrame, std: float = 0.1, seed: int = 0, key: tuple[str, str] = ("slide_id", "token_idx"), draw: Draw = seeded) -> DataFrame:
    """Gaussian noise on each embedding, from two uniform draws an element (Box-Muller) by its key and place."""
    bits = (1 << 52) - 1
    uniform = lambda i, which: (draw(seed, *key, i, F.lit(which)).bitwiseAND(F.lit(bits)) + 0.5) / float(1 << 52)
    noise = lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * np.pi * uniform(i, 1))
    return rows.withColumn("embedding", F.transform("embedding", lambda x, i: (x + std * noise(i)).cast("float")))


def distant_partner(slides: DataFrame, gap: int, seed: int = 0) -> DataFrame:
    """slide_id, idx, partner: a random other slide at least ``gap`` places away, or any other where the list
    is too short. The partner's place is arithmetic on the hash, so no pairs are made."""
    n = slides.count()
    rows = slides.select("slide_id", "idx")
    if n < 2:
        return rows.withColumn("partner", F.lit(None).cast(rows.schema["slide_id"].dataType))
    low = F.greatest(F.lit(0), F.col("idx") - gap + 1) if n > 2 * gap else F.col("idx")
    high = F.least(F.lit(n - 1), F.col("idx") + gap - 1) if n > 2 * gap else F.col("idx")
    free = F.lit(n) - (high - low + 1)
    rows = rows.withColumn("low", low).withColumn("width", high - low + 1).withColumn("pick", F.when(free > 0, F.pmod(seeded(seed, "slide_id", "idx"), free)))
    rows = rows.withColumn("other", F.col("pick") + F.when(F.col("pick") >= F.col("low"), F.col("width")).otherwise(0))
    return rows.join(slides.select(F.col("slide_id").alias("partner"), F.col("idx").alias("other")), "other", "left").select("slide_id", "idx", "partner")


def position_vectors(packs: DataFrame, dim: int = 512, temperature: float = 10000.0) -> DataFrame:
    """packs: slide_id, pack_idx, x, y. Adds position: sines and cosines of x, then of y, scaled by the
    slide's largest coordinate."""
    if dim % 4:
        raise ValueError("dim must be divisible by 4")
    top = F.max(F.greatest("x", "y")).over(Window.partitionBy("slide_id"))
    scale = lambda c: F.when(F.col("top") > 0, F.col(c) / F.col("top") * (2 * np.pi)).otherwise(F.col(c))
    rates = F.array(*[F.lit(float(temperature ** -(i / (dim // 4)))) for i in range(dim // 4)])
    wave = lambda c: F.concat(F.transform(rates, lambda r: F.sin(scale(c) * r)), F.transform(rates, lambda r: F.cos(scale(c) * r)))
    return packs.withColumn("top", top).withColumn("position", F.concat(wave("x"), wave("y"))).drop("top")


def token_positions(roles: DataFrame, positions: DataFrame, dim: int = 512) -> DataFrame:
    """Each pack's vector for all its tokens; zeros for the global token."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return roles.join(positions.select("slide_id", "pack_idx", F.col("position").alias("vector")), ["slide_id", "pack_idx"], "left").withColumn("vector", F.coalesce("vector", zeros))


def padded(rows: DataFrame, column: str = "embedding", short: int = 512, full: int = 1024) -> DataFrame:
    """Vectors of ``short`` get zeros up to ``full``; others than these two get a reject_reason."""
    size = F.size(column)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), full - short)
    out = F.when(size == full, F.col(column)).when(size == short, F.concat(column, zeros))
    return rows.withColumn("reject_reason", F.when(~size.isin(short, full) | size.isNull(), F.concat(F.lit("unexpected dimension: "), size.cast("string")))).withColumn(column, out)


def vector_mean(rows: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """The mean vector of each group, from partial sums."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    out = rows.select(*by, array_to_vector(column).alias("v")).groupBy(*by).agg(Summarizer.mean(F.col("v")).alias("m"))
    return out.select(*by, vector_to_array("m").alias("mean"))


def pooled(tokens: DataFrame, pack: int = PACK) -> DataFrame:
    """slide_id, representation: the global token and the mean of the summaries, one after the other."""
    roles = with_roles(tokens, pack)
    first = roles.where("token_type = 'global'").select("slide_id", F.transform("embedding", lambda x: x.cast("double")).alias("g"))
    return first.join(vector_mean(roles.where("token_type = 'summary'"), ["slide_id"]), "slide_id").select("slide_id", F.concat("g", "mean").alias("representation"))


def weighted_pooled(tokens: DataFrame, scores: DataFrame, temperature: float = 0.05, pack: int = PACK) -> DataFrame:
    """slide_id, representation: the global token and the softmax-weighted sum of the summaries. scores:
    slide_id, token_idx, score. The weights are taken against the slide's largest score."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    roles = with_roles(tokens, pack)
    w = Window.partitionBy("slide_id")
    rows = roles.where("token_type = 'summary'").join(scores, ["slide_id", "token_idx"])
    rows = rows.withColumn("weight", F.exp((F.col("score") - F.max("score").over(w)) / temperature))
    # a weighted mean is the sum with weights that add up to one
    mean = rows.groupBy("slide_id").agg(Summarizer.mean(array_to_vector("embedding"), F.col("weight")).alias("m")).select("slide_id", vector_to_array("m").alias("mean"))
    first = roles.where("token_type = 'global'").select("slide_id", F.transform("embedding", lambda x: x.cast("double")).alias("g"))
    return first.join(mean, "slide_id").select("slide_id", F.concat("g", "mean").alias("representation"))


def region_tokens(covered: DataFrame, summaries: DataFrame) -> DataFrame:
    """slide_id, region_id, pack_idx, embedding of the summaries of covered packs."""
    return covered.select("slide_id", "region_id", "pack_idx").join(summaries, ["slide_id", "pack_idx"]).select("slide_id", "region_id", "pack_idx", "embedding")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_centre(rows: DataFrame, centres: DataFrame, by: str = "slide_id") -> DataFrame:
    """Adds centre: of the group's centres (centre, vector) the one of the largest cosine, the lowest on ties.
    Groups have a fixed few centres, so they travel as one array."""
    every = centres.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("centre", "vector"))).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct(F.coalesce(cosine(F.col("embedding"), c["vector"]), F.lit(0.0)).alias("s"), (-c["centre"]).alias("k")))
    return rows.join(every, by).withColumn("centre", -F.array_max(scored)["k"]).drop("_c")
