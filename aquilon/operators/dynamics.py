"""Displacements, diffusion, ion speed, jumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axes, delta_phi, distance, image, norm, p_vector, water_com
from ..schema import FRAME


def _by_time(*more):
    return Window.partitionBy("trajectory_id", *more).orderBy("snapshot")


def unwrap(positions: DataFrame, keys=("trajectory_id", "atom_id"), cols=("x", "y", "z"), box=1.0, as_written: bool = False) -> DataFrame:
    """Periodic jumps taken out along time: each coordinate minus the running sum of its steps' whole boxes (half to even).
    as_written adds that sum."""
    w = Window.partitionBy(*keys).orderBy("snapshot")
    edge = (lambda k: F.lit(float(box))) if isinstance(box, (int, float)) else (lambda k: F.col(box[k]))
    sign = 1.0 if as_written else -1.0
    out = positions
    for k in cols:
        out = out.withColumn(f"_s{k}", F.coalesce(F.rint((F.col(k) - F.lag(k).over(w)) / edge(k)), F.lit(0.0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for k in cols:
        out = out.withColumn(k, F.col(k) + sign * F.sum(f"_s{k}").over(run) * edge(k))
    return out.drop(*(f"_s{k}" for k in cols))


def msd(com: DataFrame, do_unwrap: bool = False) -> DataFrame:
    """Mean squared displacement of molecules (by oxygen index) against frame 0, over the molecules of frame 0; scaled units."""
    c = com.where("cx IS NOT NULL")
    if do_unwrap:
        c = unwrap(c, ("trajectory_id", "o_idx"), ("cx", "cy", "cz"))
    zero = c.where("snapshot = 0").select("trajectory_id", "o_idx", *(F.col(f"c{k}").alias(f"z{k}") for k in "xyz"))
    n = zero.groupBy("trajectory_id").agg(F.count("*").alias("n0"))
    d = [F.col(f"c{k}") - F.col(f"z{k}") for k in "xyz"]
    s = c.join(zero, ["trajectory_id", "o_idx"]).groupBy(*FRAME).agg(F.sum(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("s"))
    return s.join(n, "trajectory_id").select(*FRAME, (F.col("s") / F.col("n0")).alias("msd"))


def diffusion_constant(m: DataFrame, timestep: float = 0.0005, eps: float = 0.1) -> DataFrame:
    """A sixth of the mean of those slopes of the MSD that lie within eps times the median of the median."""
    q = m.withColumn("q", (F.lead("msd").over(_by_time()) - F.col("msd")) / timestep).where("q IS NOT NULL")
    med = q.groupBy("trajectory_id").agg(F.median("q").alias("m"))
    near = q.join(med, "trajectory_id").where(F.abs(F.col("q") - F.col("m")) < eps * F.col("m"))
    return med.select("trajectory_id").join(near.groupBy("trajectory_id").agg((F.avg("q") / 6).alias("diffusion")), "trajectory_id", "left")


def rotational(o: DataFrame, h: DataFrame, assignment: DataFrame, timestep: float = 0.0005, shifted: bool = True, clip: bool = True) -> DataFrame:
    """Rotational mean squared displacement: molecules and their two first hydrogens are those of frame 0, followed by particle id."""
    w = Window.partitionBy("trajectory_id", "o_idx").orderBy("h_idx")
    pick = assignment.where("snapshot = 0").withColumn("k", F.row_number().over(w)).where("k <= 2")
    pick = pick.groupBy("trajectory_id", "o_idx").agg(F.max(F.when(F.col("k") == 1, F.col("h_id"))).alias("h1"), F.max(F.when(F.col("k") == 2, F.col("h_id"))).alias("h2"), F.first("o_id").alias("o_id")).where("h2 IS NOT NULL")

    def track(df, key, p):
        side = df.select(*FRAME, F.col("id").alias(key), *(F.col(k).alias(f"{p}{k}") for k in "xyz"))
        return side

    j = track(o, "o_id", "o").join(pick, ["trajectory_id", "o_id"])
    j = j.join(track(h, "h1", "a"), [*FRAME, "h1"]).join(track(h, "h2", "b"), [*FRAME, "h2"])
    a, b, c = axes("a"), axes("b"), axes("o")
    com = j.select(*FRAME, "o_idx", *(f"{s}{k}" for s in "ab" for k in "xyz"), *(e.alias(f"m{k}") for k, e in zip("xyz", water_com(a, b, c))))
    p = com.select(*FRAME, "o_idx", *(e.alias(f"p{k}") for k, e in zip("xyz", p_vector(axes("a"), axes("b"), axes("m"), shifted))))
    w = _by_time("o_idx")
    prev = p.select("*", *(F.lag(f"p{k}").over(w).alias(f"q{k}") for k in "xyz"))
    turn = prev.select(*FRAME, "o_idx", F.col("qx").isNull().alias("first"), *(e.alias(f"d{k}") for k, e in zip("xyz", delta_phi(axes("q"), axes("p"), clip))))
    turn = turn.select(*FRAME, "o_idx", *(F.when(F.col("first"), F.lit(0.0)).otherwise(F.col(f"d{k}")).alias(f"d{k}") for k in "xyz"))
    # trapezoids over the turns before this frame; the first one is 0
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    phi = [F.coalesce(timestep * (F.sum(f"d{k}").over(past) - F.lag(f"d{k}").over(w) / 2), F.lit(0.0)) for k in "xyz"]
    r = turn.select(*FRAME, "o_idx", *(e.alias(f"f{k}") for k, e in zip("xyz", phi)))
    return r.groupBy(*FRAME).agg(F.avg(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz")).alias("rmsd"))


def ion_speed(com: DataFrame, ions: DataFrame, dt: float = 0.0005, fold: bool = True) -> DataFrame:
    """Speed of the centre of mass of both ions between neighbouring frames (scaled units over dt), from frame 1 on; null where
    an ion is missing in either. fold: steps are folded into the box."""
    out = None
    for k in ("oh", "h3o"):
        c = ions.select(*FRAME, F.col(k).alias("o_idx")).join(com, [*FRAME, "o_idx"], "left")
        w = _by_time()
        d = [F.col(f"c{a}") - F.lag(f"c{a}").over(w) for a in "xyz"]
        d = [image(x) for x in d] if fold else d
        s = c.select(*FRAME, (F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / dt).alias(f"{k}_speed")).where("snapshot >= 1")
        out = s if out is None else out.join(s, FRAME)
    return out


# ---------------------------------------------------------------- the ion's particle


def ion_track(ions: DataFrame, o: DataFrame, kind: str = "h3o") -> DataFrame:
    """The particle id and place of an ion's oxygen in each frame; null where there is none."""
    side = o.select(*FRAME, F.col("idx").alias(kind), F.col("id").alias("ion_id"), "x", "y", "z", "lx", "ly", "lz")
    return ions.select(*FRAME, kind).join(side, [*FRAME, kind], "left").drop(kind)


def jumps(track: DataFrame) -> DataFrame:
    """Whether the ion sits on another particle in the next frame; no row for the last frame, null if an id is missing."""
    w = _by_time()
    t = track.withColumn("next_id", F.lead("ion_id").over(w)).withColumn("next", F.lead("snapshot").over(w))
    return t.where("next IS NOT NULL").select(*FRAME, "ion_id", (F.col("ion_id") != F.col("next_id")).alias("is_jump"))


def diffusion_runs(track: DataFrame, flush_last: bool = True, min_frames: int = 2) -> DataFrame:
    """Runs of consecutive frames without a jump: start, frames and the sum of the periodic scaled steps inside the run.
    flush_last=False leaves out the last run."""
    w = _by_time()
    still = jumps(track).where("NOT is_jump").withColumn("run", F.col("snapshot") - F.row_number().over(w))
    c = still.join(track.select(*FRAME, "x", "y", "z"), FRAME)
    r = _by_time("run")
    d = [image(F.col(k) - F.lag(k).over(r)) for k in "xyz"]
    s = c.withColumn("d", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    g = s.groupBy("trajectory_id", "run").agg(F.min("snapshot").alias("start"), F.count("*").alias("frames"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"))
    if not flush_last:
        last = g.groupBy("trajectory_id").agg(F.max("start").alias("last"))
        g = g.join(last, "trajectory_id").where("start <> last").drop("last")
    return g.where(F.col("frames") >= min_frames).select("trajectory_id", "start", "frames", "distance")


def jump_distances(track: DataFrame, as_written: bool = False) -> DataFrame:
    """Periodic scaled distance that the ion covers in each jump, from the frame of the jump to the next one.
    as_written: from the frame before the jump to that of the jump."""
    w = _by_time()
    step = F.lag if as_written else F.lead
    t = track.select(*FRAME, "x", "y", "z", *(step(k).over(w).alias(f"n{k}") for k in "xyz"))
    d = distance(axes(), axes("n"), mode="pbc")
    return jumps(track).where("is_jump").join(t, FRAME).select(*FRAME, d.alias("distance"))


def diffusion_chunks(track: DataFrame) -> DataFrame:
    """Stretches between jumps as inclusive frames start, end: each ends with a jump frame; the tail counts where frames are left."""
    w = _by_time()
    j = jumps(track).where("is_jump").select("trajectory_id", F.col("snapshot").alias("end")).withColumn("start", F.coalesce(F.lag("end").over(Window.partitionBy("trajectory_id").orderBy("end")) + 1, F.lit(0)))
    n = track.groupBy("trajectory_id").agg(F.max("snapshot").alias("last"))
    tail = n.join(j.groupBy("trajectory_id").agg(F.max("end").alias("e")), "trajectory_id", "left").where("e IS NULL OR e < last")
    return j.select("trajectory_id", "start", "end").union(tail.select("trajectory_id", F.coalesce(F.col("e") + 1, F.lit(0)), "last"))


def path_ang(track: DataFrame) -> DataFrame:
    """The ion's places in length units, in order: trajectory_id, pos (from 0), x, y, z."""
    t = track.where("ion_id IS NOT NULL")
    return t.select("trajectory_id", "snapshot", (F.row_number().over(_by_time()) - 1).alias("pos"), *((F.col(k) * F.col(f"l{k}")).alias(k) for k in "xyz"))


def lag_msd(path: DataFrame, keys=("trajectory_id",), max_lag: int | None = None) -> DataFrame:
    """Mean squared displacement by lag over all origins of a path (keys, pos, x, y, z). max_lag bounds the pairs of a long path."""
    b = path.select(*keys, F.col("pos").alias("q"), *(F.col(k).alias(f"b{k}") for k in "xyz"))
    j = path.join(b, list(keys)).where("q > pos")
    if max_lag is not None:
        j = j.where(F.col("q") - F.col("pos") <= max_lag)
    d = [F.col(f"b{k}") - F.col(k) for k in "xyz"]
    return j.groupBy(*keys, (F.col("q") - F.col("pos")).cast("long").alias("lag")).agg(F.avg(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("msd"))


def chunked_msd(track: DataFrame) -> DataFrame:
    """Lag MSD inside each diffusion chunk of two frames or more, then the mean over chunks by lag."""
    p = path_ang(track)
    c = diffusion_chunks(track)
    inside = p.join(c, "trajectory_id").where("snapshot BETWEEN start AND end").select("trajectory_id", "start", F.col("snapshot").alias("pos"), "x", "y", "z")
    return lag_msd(inside, ("trajectory_id", "start")).groupBy("trajectory_id", "lag").agg(F.avg("msd").alias("msd"))


def stitched(track: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diffusive path, jump path) in length units as (trajectory_id, pos, x, y, z).

    The diffusive path leaves out the frames of jumps and moves each stretch to begin where the one before ended. The jump
    path starts at 0 and adds the displacement of each jump; differences are not folded."""
    w = _by_time()
    p = path_ang(track).select("trajectory_id", "snapshot", "x", "y", "z")
    j = jumps(track).select(*FRAME, "is_jump")
    t = p.join(j, FRAME, "left").withColumn("is_jump", F.coalesce("is_jump", F.lit(False)))
    keep = t.where("NOT is_jump")
    step = [F.when(F.col("snapshot") - F.lag("snapshot").over(w) == 1, F.col(k) - F.lag(k).over(w)).otherwise(F.lit(0.0)) for k in "xyz"]
    s = keep.select(*FRAME, *(e.alias(f"s{k}") for k, e in zip("xyz", step)), *(F.first(k).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"f{k}") for k in "xyz"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    diff = s.select("trajectory_id", (F.row_number().over(w) - 1).alias("pos"), *((F.col(f"f{k}") + F.sum(f"s{k}").over(run)).alias(k) for k in "xyz"))
    n = p.select(*FRAME, *((F.lead(k).over(w) - F.col(k)).alias(k) for k in "xyz"))
    hop = n.join(j.where("is_jump").select(*FRAME), FRAME)
    hop = hop.select("trajectory_id", F.row_number().over(w).alias("pos"), *(F.sum(k).over(run).alias(k) for k in "xyz"))
    zero = track.select("trajectory_id").distinct().select("trajectory_id", F.lit(0).alias("pos"), *(F.lit(0.0).alias(k) for k in "xyz"))
    return diff, zero.union(hop)
