"""Molecules, ions and recombination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axes, distance, image
from ..schema import FRAME, MASS_H, MASS_O


def molecules(o: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row for each oxygen: o_idx, o_id, n_h, h_list (ascending h_idx). Bare oxygens stay."""
    g = assignment.groupBy(*FRAME, "o_idx").agg(F.sort_array(F.collect_list("h_idx")).alias("h_list"))
    base = o.select(*FRAME, F.col("idx").alias("o_idx"), F.col("id").alias("o_id"))
    return base.join(g, [*FRAME, "o_idx"], "left").withColumn("h_list", F.coalesce("h_list", F.array().cast("array<int>"))).withColumn("n_h", F.size("h_list"))


def ions(mol: DataFrame, carry: bool = False, first: bool = False) -> DataFrame:
    """oh, h3o: index of the oxygen with one and with three hydrogens, null where there is none. Of several the last
    counts (first=True: the first). carry: a frame without an ion takes that of the frame before."""
    pick = F.min if first else F.max
    out = mol.groupBy(*FRAME).agg(pick(F.when(F.col("n_h") == 1, F.col("o_idx"))).alias("oh"), pick(F.when(F.col("n_h") == 3, F.col("o_idx"))).alias("h3o"))
    if carry:
        w = Window.partitionBy("trajectory_id").orderBy("snapshot").rowsBetween(Window.unboundedPreceding, 0)
        out = out.select(*FRAME, F.last("oh", True).over(w).alias("oh"), F.last("h3o", True).over(w).alias("h3o"))
    return out


def recombination(mol: DataFrame) -> DataFrame:
    """recombination_time: the first frame where every oxygen holds two hydrogens, else the number of frames; did_recombine."""
    f = mol.groupBy(*FRAME).agg(F.bool_and(F.col("n_h") == 2).alias("whole"))
    g = f.groupBy("trajectory_id").agg(F.min(F.when(F.col("whole"), F.col("snapshot"))).alias("t"), F.count("*").alias("n"))
    return g.select("trajectory_id", F.coalesce("t", "n").alias("recombination_time"), F.col("t").isNotNull().alias("did_recombine"))


def before(df: DataFrame, rec: DataFrame) -> DataFrame:
    """The frames before recombination."""
    return df.join(rec.select("trajectory_id", "recombination_time"), "trajectory_id").where("snapshot < recombination_time").drop("recombination_time")


def ion_distance(ions_: DataFrame, o: DataFrame) -> DataFrame:
    """Places of both ions (scaled) and their periodic distance, scaled and in length units; null where one is missing."""
    a = o.select(*FRAME, F.col("idx").alias("oh"), *(F.col(k).alias(f"oh_{k}") for k in "xyz"))
    b = o.select(*FRAME, F.col("idx").alias("h3o"), *(F.col(k).alias(f"h3o_{k}") for k in "xyz"), "lx", "ly", "lz")
    j = ions_.join(a, [*FRAME, "oh"], "left").join(b, [*FRAME, "h3o"], "left")
    ang = [image((F.col(f"oh_{k}") - F.col(f"h3o_{k}")) * F.col(f"l{k}"), F.col(f"l{k}")) for k in "xyz"]
    both = F.col("oh").isNotNull() & F.col("h3o").isNotNull()
    only = lambda c: F.when(both, c)
    return j.select(*FRAME, "oh", "h3o", *(only(F.col(f"{s}_{k}")).alias(f"{s}_{k}") for s in ("oh", "h3o") for k in "xyz"),
                    only(distance(axes("oh_"), axes("h3o_"), mode="pbc")).alias("dist_scaled"), only(F.sqrt(ang[0] * ang[0] + ang[1] * ang[1] + ang[2] * ang[2])).alias("dist_ang"))


def centres(o: DataFrame, h: DataFrame, assignment: DataFrame, whole: bool = False) -> DataFrame:
    """Centre of mass of every molecule with one to three hydrogens (others null), linear in scaled coordinates.
    whole: hydrogens are first brought to the image next to their oxygen."""
    hy = h.select(*FRAME, F.col("idx").alias("h_idx"), *(F.col(k).alias(f"h{k}") for k in "xyz"))
    m = assignment.select(*FRAME, "h_idx", "o_idx").join(hy, [*FRAME, "h_idx"])
    ox = o.select(*FRAME, F.col("idx").alias("o_idx"), F.col("id").alias("o_id"), *(F.col(k).alias(f"o{k}") for k in "xyz"))
    if whole:
        m = m.join(ox, [*FRAME, "o_idx"]).select(*FRAME, "o_idx", *((F.col(f"o{k}") + image(F.col(f"h{k}") - F.col(f"o{k}"))).alias(f"h{k}") for k in "xyz"))
    g = m.groupBy(*FRAME, "o_idx").agg(F.count("*").cast("int").alias("n_h"), *(F.sum(f"h{k}").alias(f"s{k}") for k in "xyz"))
    j = ox.join(g, [*FRAME, "o_idx"], "left")
    ok = F.col("n_h").between(1, 3)
    return j.select(*FRAME, "o_idx", "o_id", F.coalesce("n_h", F.lit(0)).alias("n_h"),
                    *(F.when(ok, (F.lit(MASS_O) * F.col(f"o{k}") + F.lit(MASS_H) * F.col(f"s{k}")) / (F.lit(MASS_O) + F.lit(MASS_H) * F.col("n_h"))).alias(f"c{k}") for k in "xyz"))


def hydrogen_histogram(mol: DataFrame) -> DataFrame:
    """How many oxygens of each frame hold n_h hydrogens, and their share."""
    n = mol.groupBy(*FRAME, "n_h").agg(F.count("*").alias("n"))
    total = mol.groupBy(*FRAME).agg(F.count("*").alias("total"))
    return n.join(total, FRAME).select(*FRAME, "n_h", "n", (F.col("n") / F.col("total")).alias("density"))
