"""Similarity clusters of fingerprints by grid density clustering.

The 64-bit hash is quantised to four 16-bit bands: each (project, band, value) is
a cell of the grid.  Assets with the same evidence are one point with a count.

1. Cells are counted; the point with the most copies in a cell is its hub, and
   every point of the cell is verified against the hub.  Minimum labels are spread
   over these links: dense cells become one label at linear cost.
2. Cells are adjacent when their values differ in at most two bits: two hashes
   within 10 bits differ by at most 2 in one of the four bands.  Adjacent cells are
   found among the cells, not the points, by flipping one bit on both sides.  Only
   cells of different labels matter; their points are met and verified.
3. Minimum labels are spread over the verified links between labels.

Two adjacent cells that both hold many points (hashes that share a band, as blank
borders make them) don't meet all their points: the pair becomes a grid of its own
over the three other bands, where 10 bits leave at most 3, 3 or 2 to one of them.
The relation links any two points, so the least density of a cell is one point.

All steps together find every link between labels, so the result equals the
connected components over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components, salted_join
from ..operators.similarity import WEIGHTS, color_similarity, hex_bits
from ..session import cut, merge_join

NEAR_DISTANCE, NEAR_SIMILARITY = 10, 0.86
BANDS, BITS = 4, 16
CROWD = 256  # points of both of two adjacent cells from which on they become a grid of their own
SHARE = 1024  # points of a cell that one task meets with its neighbours


def points(evidence: DataFrame) -> DataFrame:
    """``project_id, asset_id, key, bits, color, lum``: one row per asset with usable evidence.

    Hashes are 16 hex digits in either case.  A null array counts as empty, and an
    asset with an empty array can't reach the similarity gate with any other, so
    it is left out, as are rows without asset or project.  An asset with several
    different evidence rows in a project counts with the smallest.
    """
    ok = evidence.where(
        F.col("asset_id").isNotNull() & F.col("project_id").isNotNull() & F.col("perceptual_hash").rlike("^[0-9a-fA-F]{16}$")
        & (F.size("color_signature") > 0) & (F.size("embedding") > 0)
    )
    row = F.min(F.struct(F.lower("perceptual_hash").alias("hash"), "color_signature", "embedding")).alias("r")
    one = ok.groupBy("project_id", "asset_id").agg(row).select("project_id", "asset_id", "r.*")
    # Two 64-bit hashes beside the bits themselves tell pieces of evidence apart.
    key = F.concat_ws("-", "hash", F.xxhash64("project_id", "color_signature", "embedding").cast("string"), F.xxhash64(F.lit(1), "embedding", "color_signature", "project_id").cast("string"))
    return one.select("project_id", "asset_id", key.alias("key"), hex_bits("hash").alias("bits"), F.col("color_signature").alias("color"), F.col("embedding").alias("lum"))


def _dot(a: str, b: str) -> Column:
    times = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("int") * F.coalesce(y, F.lit(0)).cast("int"))
    return F.aggregate(times, F.lit(0), lambda s, x: s + x)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _verified(pairs: DataFrame, nodes: DataFrame, gate: tuple[int, float]) -> DataFrame:
    """The pairs ``a, b`` (ids) that pass the gate; the weights are those of the visual similarity."""
    side = lambda x: nodes.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("project_id", "bits", "color", "lum", "square")])
    both = merge_join(merge_join(pairs, side("a"), "a"), side("b"), "b").where("a_project_id = b_project_id").withColumn("d", _distance("a_bits", "b_bits"))
    cos = _dot("a_lum", "b_lum").cast("double") / (F.sqrt(F.col("a_square").cast("double")) * F.sqrt(F.col("b_square").cast("double")))
    unit = F.when((F.col("a_square") > 0) & (F.col("b_square") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1.0) / 2.0))).otherwise(F.lit(0.5))
    light = F.when(F.size("a_lum") == F.size("b_lum"), unit).otherwise(F.lit(0.0))
    near = (1.0 - F.col("d") / 64.0) * WEIGHTS[0] + color_similarity("a_color", "b_color") * WEIGHTS[1] + light * WEIGHTS[2]
    return both.where((F.col("d") <= gate[0]) & (near >= gate[1])).select("a", "b")


def _band(bits: Column, band: int) -> Column:
    return F.shiftrightunsigned(bits, band * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _placed(items: DataFrame, bands: list[int], *carried: str) -> DataFrame:
    """Every item in its cell of each band: ``cell`` (a number made of grid, band and value), ``band``, ``value``."""
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), _band(F.col("bits"), b).alias("value")) for b in bands])).alias("at")
    rows = items.select("grid", *carried, at)
    return rows.select(F.xxhash64("grid", "at.band", "at.value").alias("cell"), "grid", "at.band", "at.value", *carried)


def _flips(least: int, most: int) -> list[int]:
    """The band values of ``least`` to ``most`` set bits."""
    return [v for v in range(1 << BITS) if least <= v.bit_count() <= most]


def _adjacent(cells: DataFrame, bands: list[int], reach: dict[int, int]) -> DataFrame:
    """``one, two`` of different cells of a band within ``reach`` bits, and their numbers of points, but for cells of one label only.

    One side flips half of the bits, the other the rest, so that both come to a
    common value.
    """
    kinds = sorted({reach[b] for b in bands})
    out = None
    for r in kinds:
        mine = cells.where(F.col("band").isin([b for b in bands if reach[b] == r]))

        def moved(bits: int, side: str, mine=mine) -> DataFrame:
            step = F.explode(F.array(*[F.lit(v) for v in _flips(0, bits)])).alias("step")
            rows = mine.select("grid", "band", "value", F.col("cell").alias(side), F.col("only").alias(f"{side}_only"), F.col("n").alias(f"{side}_n"), step)
            return rows.select(F.xxhash64("grid", "band", F.col("value").bitwiseXOR(F.col("step"))).alias("key"), side, f"{side}_only", f"{side}_n")

        meet = merge_join(moved(r // 2, "one"), moved(r - r // 2, "two"), "key")
        other = (F.col("one_only") != F.col("two_only")) | (F.col("one_only") < 0)
        order = F.col("one") < F.col("two") if r % 2 == 0 else F.col("one") != F.col("two")
        pairs = meet.where(order & other).select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"), F.when(F.col("one") < F.col("two"), F.col("one_n")).otherwise(F.col("two_n")).alias("one_n"), F.when(F.col("one") < F.col("two"), F.col("two_n")).otherwise(F.col("one_n")).alias("two_n"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _close(items: DataFrame, bands: list[int], distance: int) -> DataFrame:
    """``a, b`` of all items (``grid, id, label, bits``) of one grid and different labels within ``distance`` bits.

    ``distance`` may lie in the given bands in any way: of its bits at most
    ``distance // n`` lie in one of n bands, and in the last of them even fewer.
    """
    n = len(bands)
    # The least sum of bits that exceeds the distance in no band: reach adds up to distance - n + 1.
    spare = distance - n + 1
    reach = {b: spare // n + (1 if k < spare % n else 0) for k, b in enumerate(bands)}
    placed = cut(_placed(items, bands, "id", "label", "bits"))
    cells = cut(
        placed.groupBy("cell", "grid", "band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        .select("cell", "grid", "band", "value", "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(-1)).alias("only"))
    )
    within = cells.where("only < 0").select(F.col("cell").alias("one"), F.col("cell").alias("two"), F.col("n").alias("one_n"), F.col("n").alias("two_n"))
    pairs = cut(_adjacent(cells, bands, reach).unionByName(within))
    crowded = F.least("one_n", "two_n") > CROWD
    # The smaller cell's points come first; the larger cell is met in shares.
    turn = lambda x, y: F.when(F.col("one_n") <= F.col("two_n"), F.col(x)).otherwise(F.col(y))
    shares = F.ceil(F.greatest("one_n", "two_n") / F.lit(SHARE)).cast("int")
    light = (pairs.where(~crowded) if n > 2 else pairs).select(turn("one", "two").alias("cell"), turn("two", "one").alias("big"), shares.alias("shares"))
    few = merge_join(light, placed.select("cell", F.col("id").alias("a"), F.col("label").alias("la"), F.col("bits").alias("ba")), "cell")
    few = few.select("a", "la", "ba", F.col("big").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    large = cells.where(F.col("n") > SHARE).select("cell", F.ceil(F.col("n") / F.lit(SHARE)).cast("int").alias("shares"))
    many = salted_join(placed.select("cell", "id", "label", "bits"), large, ["cell"], "id", how="left")
    many = many.select("cell", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("bits").alias("bb"), F.coalesce(F.pmod(F.xxhash64("id"), F.col("shares")), F.lit(0)).cast("int").alias("share"))
    met = merge_join(few, many, ["cell", "share"]).where((F.col("la") != F.col("lb")) & (_distance("ba", "bb") <= distance))
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if n <= 2:
        return found
    heavy = cut(pairs.where(crowded).select("one", "two"))
    # At most one row a band.
    for b in [r["band"] for r in merge_join(heavy.select(F.col("one").alias("cell")), cells.select("cell", "band"), "cell").select("band").distinct().collect()]:
        both = heavy.select(F.xxhash64("one", "two").alias("grid"), F.explode(F.array_distinct(F.array("one", "two"))).alias("cell"))
        inner = merge_join(placed.where(F.col("band") == b).select("cell", "id", "label", "bits"), both, "cell").select("grid", "id", "label", "bits")
        found = found.unionByName(_close(inner, [x for x in bands if x != b], distance))
    return found


def label_points(nodes: DataFrame, gate: tuple[int, float] = (NEAR_DISTANCE, NEAR_SIMILARITY)) -> DataFrame:
    """``id, label`` of every node (``id, project_id, grid, bits, color, lum, square, copies``); the label is a node's id."""
    bands = list(range(BANDS))
    placed = _placed(nodes, bands, "id", "bits", "copies")
    hubs = placed.groupBy("cell").agg(F.min(F.struct(-F.col("copies"), F.col("id").alias("hub"), F.col("bits").alias("hub_bits"))).alias("h"), F.count(F.lit(1)).alias("points")).where("points > 1")
    around = salted_join(placed.select("cell", "id", "bits"), hubs.select("cell", "h.hub", "h.hub_bits"), ["cell"], "id", salts=4)
    stars = around.where((F.col("id") != F.col("hub")) & (_distance("bits", "hub_bits") <= gate[0])).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    first = connected_components(cut(_verified(stars, nodes, gate)), "a", "b")
    labelled = cut(merge_join(nodes.select("id", "grid", "bits"), first.select(F.col("node").alias("id"), "label"), "id", "left").select("id", "grid", "bits", F.coalesce("label", "id").alias("label")))
    more = _verified(_close(labelled, bands, gate[0]).distinct(), nodes, gate)
    name = labelled.select("id", "label")
    at = lambda x: name.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    between = cut(merge_join(merge_join(more, at("a"), "a"), at("b"), "b").select("la", "lb").distinct())
    top = connected_components(between, "la", "lb")
    return merge_join(name, top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label"))


def cluster_members(evidence: DataFrame, gate: tuple[int, float] = (NEAR_DISTANCE, NEAR_SIMILARITY)) -> DataFrame:
    """``project_id, cluster_id, asset_id, bits`` of every asset in a cluster of two or more.

    ``cluster_id`` is the smallest asset of the cluster.  An empty table has no clusters.
    """
    assets = cut(points(evidence))
    one = assets.groupBy("key").agg(F.min("project_id").alias("project_id"), F.min("bits").alias("bits"), F.first("color").alias("color"), F.first("lum").alias("lum"), F.count(F.lit(1)).alias("copies"), F.min("asset_id").alias("least"))
    # Numbers stay as they are once written; a grid number shared by two projects is told apart when pairs are verified.
    nodes = cut(one.withColumns({"grid": F.xxhash64("project_id"), "square": _dot("lum", "lum"), "id": F.monotonically_increasing_id()}))
    label = cut(merge_join(label_points(nodes, gate), nodes.select("id", "key", "copies", "least"), "id").select("key", "label", "copies", "least"))
    size = label.groupBy("label").agg(F.sum("copies").alias("n"), F.min("least").alias("cluster_id")).where("n > 1")
    of_key = salted_join(label.select("key", "label"), size, ["label"], "key", salts=4).select("key", "cluster_id")
    return salted_join(assets.select("project_id", "asset_id", "bits", "key"), of_key, ["key"], "asset_id").select("project_id", "cluster_id", "asset_id", "bits")


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """Size of each cluster and its most typical members: those in its densest cells, smallest ids first."""
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), _band(F.col("bits"), b).alias("value")) for b in range(BANDS)])).alias("cell")
    placed = members.select("cluster_id", "asset_id", cells).select("cluster_id", "asset_id", "cell.*")
    dense = placed.groupBy("cluster_id", "band", "value").agg(F.count(F.lit(1)).alias("n"))
    score = salted_join(placed, dense, ["cluster_id", "band", "value"], "asset_id", salts=4).groupBy("cluster_id", "asset_id").agg(F.sum("n").alias("density"))
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("density"), "asset_id"))
    top = score.withColumn("rank", rank).where(F.col("rank") <= typical).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "asset_id"))).alias("t"))
    sizes = members.groupBy("project_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    return merge_join(sizes, top, "cluster_id").select("project_id", "cluster_id", "n_members", F.array_join(F.col("t.asset_id"), ",").alias("typical_members"))
