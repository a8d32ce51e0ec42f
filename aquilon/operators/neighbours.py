"""Joins by distance within frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axes, distance, image, minus, norm2
from ..schema import FRAME


def scaled_to_box(df: DataFrame, prefix: str = "") -> list[Column]:
    """Coordinates in length units: scaled times the edges lx, ly, lz of the same row."""
    return [F.col(f"{prefix}{k}") * F.col(f"l{k}") for k in "xyz"]


def _prefixed(df: DataFrame, p: str, keep=("idx", "id", "x", "y", "z")) -> DataFrame:
    return df.select(*FRAME, *(F.col(k).alias(f"{p}{k}") for k in keep))


def frame_pairs(a: DataFrame, b: DataFrame, mode: str = "pbc", extra_a=(), extra_b=()) -> DataFrame:
    """Every a_ with every b_ of the same frame, with squared distance d2 in length units. The sides carry idx, id, scaled
    x, y, z; a also the edges. Both are dealt by frame, so it is an equi-join without a further exchange."""
    left = a.select(*FRAME, "lx", "ly", "lz", *(F.col(k).alias(f"a_{k}") for k in ("idx", "id", "x", "y", "z", *extra_a)))
    right = _prefixed(b, "b_", ("idx", "id", "x", "y", "z", *extra_b))
    d = [(F.col(f"a_{k}") * F.col(f"l{k}") - F.col(f"b_{k}") * F.col(f"l{k}")) for k in "xyz"]
    d = d if mode == "normal" else [image(v, F.col(f"l{k}")) for v, k in zip(d, "xyz")]
    return left.join(right, FRAME).withColumn("d2", norm2(d))


def cells(df: DataFrame, edge: float, halo: bool) -> DataFrame:
    """Adds cell numbers cx, cy, cz for cells at least `edge` long; with halo a row for each of the up to 27 cells around. An axis
    shorter than four edges has one cell: with three, the halo is all of them, for the same pairs from three times the rows."""
    n = {k: F.when(F.floor(F.col(f"l{k}") / edge) >= 4, F.floor(F.col(f"l{k}") / edge)).otherwise(F.lit(1)) for k in "xyz"}
    for k in "xyz":
        own = F.least(F.greatest(F.floor((F.col(k) - F.floor(F.col(k))) * n[k]), F.lit(0)), n[k] - 1)
        if halo:
            near = F.when(n[k] == 1, F.array(F.lit(0))).otherwise(F.array(*(F.pmod(own + F.lit(s), n[k]).cast("int") for s in (-1, 0, 1))))
            df = df.withColumn(f"c{k}", F.explode(near))
        else:
            df = df.withColumn(f"c{k}", own.cast("int"))
    return df


def within(a: DataFrame, b: DataFrame, cutoff: float, same: bool = False) -> DataFrame:
    """Pairs a_, b_ of a frame at periodic distance <= cutoff, through a cell list: b stands in its cell, a looks into
    the cells around, so the pairs compared grow with the number of atoms. same: leaves out pairs with equal idx."""
    keys = [*FRAME, "cx", "cy", "cz"]
    left = cells(a, cutoff, True).select(*keys, "lx", "ly", "lz", *(F.col(k).alias(f"a_{k}") for k in ("idx", "id", "x", "y", "z")))
    right = cells(b, cutoff, False).select(*keys, *(F.col(k).alias(f"b_{k}") for k in ("idx", "id", "x", "y", "z")))
    d = [image(F.col(f"a_{k}") * F.col(f"l{k}") - F.col(f"b_{k}") * F.col(f"l{k}"), F.col(f"l{k}")) for k in "xyz"]
    out = left.join(right, keys).withColumn("d2", norm2(d)).where(F.sqrt("d2") <= cutoff).drop("cx", "cy", "cz")
    return out.where("a_idx <> b_idx") if same else out


def nearest(h: DataFrame, o: DataFrame, mode: str = "pbc", cell: float | None = None) -> DataFrame:
    """The nearest o for each h: h_idx, h_id, o_idx, o_id, dist (length units); ties go to the smallest o_idx.

    cell: looks through a cell list first; a hydrogen without an oxygen within `cell` takes the full frame.
    """
    best = F.min(F.struct(F.col("d2"), F.col("b_idx").alias("o_idx"), F.col("b_id").alias("o_id"))).alias("m")
    keys = [*FRAME, "a_idx", "a_id"]
    if cell is None or mode != "pbc":
        out = frame_pairs(h, o, mode).groupBy(*keys).agg(best)
    else:
        near = within(h, o, cell).groupBy(*keys).agg(best)
        all_h = h.select(*FRAME, *(F.col(k) for k in ("idx", "id", "x", "y", "z", "lx", "ly", "lz")))
        found = all_h.join(near.withColumnsRenamed({"a_idx": "idx", "a_id": "id"}), [*FRAME, "idx", "id"], "left")  # one plan of near for both
        rest = frame_pairs(found.where("m IS NULL").drop("m"), o, mode).groupBy(*keys).agg(best)
        out = found.where("m IS NOT NULL").select(*FRAME, F.col("idx").alias("a_idx"), F.col("id").alias("a_id"), "m").unionByName(rest)
    return out.select(*FRAME, F.col("a_idx").alias("h_idx"), F.col("a_id").alias("h_id"), "m.o_idx", "m.o_id", F.sqrt("m.d2").alias("dist"))


def k_nearest(o: DataFrame, k: int = 19) -> DataFrame:
    """The k nearest others of each point, ranked from 1 by (distance, index)."""
    w = Window.partitionBy(*FRAME, "a_idx").orderBy("d2", "b_idx")
    p = frame_pairs(o, o).where("a_idx <> b_idx")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*FRAME, F.col("a_idx").alias("o_idx"), F.col("b_idx").alias("n_idx"), "rank", F.sqrt("d2").alias("dist"))


def all_distances(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """The periodic distance matrix of a frame: a with itself (with zero diagonal) or with b."""
    return frame_pairs(a, a if b is None else b).select(*FRAME, "a_idx", "b_idx", F.sqrt("d2").alias("dist"))


def ball_counts(a: DataFrame, b: DataFrame, radii: list[float]) -> DataFrame:
    """How many b stand within each radius of any a of the frame (pairs, self left out)."""
    p = within(a, b, float(max(radii))).where("d2 > 0").select(*FRAME, F.sqrt("d2").alias("d"))
    r = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(x)).alias("r")) for i, x in enumerate(radii)]))
    return p.select(*FRAME, "d", r.alias("k")).where(F.col("d") <= F.col("k.r")).groupBy(*FRAME, F.col("k.bin").alias("bin"), F.col("k.r").alias("r")).agg(F.count("*").alias("n"))
