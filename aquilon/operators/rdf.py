"""Radial distribution functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import sphere_volume
from ..schema import FRAME
from .neighbours import frame_pairs, within

TYPES = ("OO", "HH", "OH", "OH_ion", "H3O_ion")


def rdf(t, gr_type: str = "OO", n_bins: int = 50, start: float = 0.01, stop: float | None = None, snapshot: int | None = None, per_frame: bool = False) -> DataFrame:
    """g(r) of a trajectory frame object: trajectory_id, gr_type, bin, r (right edge), g; the unweighted mean over frames, one frame
    (snapshot) or each frame (per_frame).

    Edges: n_bins points from start to stop (default: half the shortest edge). Bins are half-open, the last is closed; bins
    without pairs are 0. OO, HH, OH: ordered pairs, density of the second species. Ion types count around the ion of
    the frames before recombination; a frame without the ion is left out, and one frame alone has no ion type.
    """
    if gr_type not in TYPES:
        raise ValueError(f"gr_type must be one of {TYPES}")
    if "ion" in gr_type and snapshot is not None:
        raise ValueError("ion functions need all frames")
    frames = t.frames if snapshot is None else t.frames.where(F.col("snapshot") == snapshot)
    side = {"OO": (t.o, t.o), "HH": (t.h, t.h), "OH": (t.o, t.h)}.get(gr_type, (t.o, t.o))
    a, b = side
    if "ion" in gr_type:
        kind = "oh" if gr_type == "OH_ion" else "h3o"
        ion = t.before(t.first_ions).where(F.col(kind).isNotNull()).select(*FRAME, F.col(kind).alias("idx"))
        a = t.o.join(ion, [*FRAME, "idx"])
        frames = frames.join(ion.select(*FRAME), FRAME)
    if snapshot is not None:
        a = a.where(F.col("snapshot") == snapshot)
    n_ref = F.lit(1.0) if "ion" in gr_type else F.col("n_a").cast("double")
    edge = F.lit(float(stop)) if stop is not None else F.least("lx", "ly", "lz") / 2
    sizes = frames.select(*FRAME, "lx", "ly", "lz", edge.alias("stop")).join(t.counts, FRAME)
    sizes = sizes.select(*FRAME, "stop", (F.col("lx") * F.col("ly") * F.col("lz")).alias("volume"), F.col("n_h" if gr_type == "HH" else "n_o").alias("n_a"), F.col("n_h" if gr_type in ("HH", "OH") else "n_o").alias("n_b"))
    # the box travels with each row, so a pair finds its bin without a join
    e = F.lit(float(stop)) if stop is not None else F.least("lx", "ly", "lz") / 2
    p = frame_pairs(a, b) if stop is None else within(a, b, float(stop))
    once = gr_type in ("OO", "HH") and start > 0  # a pair and its mirror image are alike, and no atom pairs with itself
    p = p.where("a_idx < b_idx") if once else p
    d = p.select(*FRAME, F.sqrt("d2").alias("d"), e.alias("stop")).where((F.col("d") >= start) & (F.col("d") <= F.col("stop")))
    step = (F.col("stop") - start) / (n_bins - 1)
    hits = d.select(*FRAME, F.least(F.floor((F.col("d") - start) / step), F.lit(n_bins - 2)).cast("int").alias("bin")).groupBy(*FRAME, "bin").agg((F.count("*") * (2 if once else 1)).alias("n"))
    # pairs first, then the bins of a frame as an array: empty bins come from the frame, not from a join of all bins
    per = hits.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("hits"))
    full = sizes.join(per, FRAME, "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 2))).alias("bin"))
    lo, hi = F.lit(start) + F.col("bin") * step, F.lit(start) + (F.col("bin") + 1) * step
    shell = sphere_volume(hi) - sphere_volume(lo)
    n = F.coalesce(F.try_element_at("hits", F.col("bin")), F.lit(0)).cast("double")
    g = full.select(*FRAME, "bin", hi.alias("r"), F.try_divide(n * F.col("volume"), n_ref * shell * F.col("n_b")).alias("g"))
    if per_frame or snapshot is not None:
        return g.select(*FRAME, F.lit(gr_type).alias("gr_type"), "bin", "r", "g")
    return g.groupBy("trajectory_id", "bin").agg(F.avg("r").alias("r"), F.avg("g").alias("g")).select("trajectory_id", F.lit(gr_type).alias("gr_type"), "bin", "r", "g")


def averaged(t, gr_types=("OO",), n_bins: int = 50, start: float = 0.01, stop: float = 8.0) -> DataFrame:
    """Mean g(r) over the trajectories that recombined, each with equal weight: gr_type, bin, r, g."""
    done = t.recombination.where("did_recombine").select("trajectory_id")
    out = None
    for k in gr_types:
        one = rdf(t, k, n_bins, start, stop).join(done, "trajectory_id", "left_semi").groupBy("gr_type", "bin").agg(F.avg("r").alias("r"), F.avg("g").alias("g"))
        out = one if out is None else out.unionByName(one)
    return out


def cumulative(g: DataFrame) -> DataFrame:
    """Running sum of g over bins and, back from it, the differences."""
    from pyspark.sql import Window

    w = Window.partitionBy("trajectory_id", "gr_type").orderBy("bin")
    c = g.withColumn("cumulative", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.withColumn("difference", F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)))
