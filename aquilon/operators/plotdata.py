"""The rows behind each figure; drawing is left to the reader's own tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAME
from . import hbonds, stats


def time_axis(df: DataFrame, dt: float = 0.0005, order: str = "snapshot") -> DataFrame:
    """Adds time: n points from 0 to n * dt inclusive."""
    n = F.count("*").over(Window.partitionBy("trajectory_id"))
    i = F.row_number().over(Window.partitionBy("trajectory_id").orderBy(order)) - 1
    return df.withColumn("time", F.coalesce(dt * i * F.try_divide(n, n - 1), F.lit(0.0)))


def ion_distance_data(t, dt: float = 0.0005) -> DataFrame:
    return time_axis(t.before(t.ion_distance()).select(*FRAME, "dist_scaled", "dist_ang"), dt)


def rotational_data(t, dt: float = 0.0005) -> DataFrame:
    return time_axis(t.rotational_diffusion(dt), dt)


def msd_data(t, dt: float = 0.0005) -> DataFrame:
    return time_axis(t.msd(), dt)


def ion_speed_data(t, dt: float = 0.0005) -> DataFrame:
    return time_axis(t.ion_speed(dt), dt)


def rdf_data(t, gr_type: str = "OO", **options) -> DataFrame:
    return t.rdf(gr_type, **options)


def hbonds_single_data(t, snapshot: int = 0, root: str = "h3o", cutoff: float = 3.6) -> DataFrame:
    """Undirected bonds of one frame with the places of both ends."""
    one = hbonds.mirror_free(t.at(snapshot).hbond_network(root, cutoff))
    side = lambda p: t.o.select(*FRAME, F.col("idx").alias(f"{p}_o"), *(F.col(k).alias(f"{p}_{k}") for k in "xyz"))
    return one.join(side("a"), [*FRAME, "a_o"]).join(side("b"), [*FRAME, "b_o"])


def hb_network_data(t, cutoff: float = 2.9) -> DataFrame:
    """hbonds_single_data for both ions and every frame before recombination."""
    net = t.hb_timeseries(cutoff)
    pairs = net.select(*FRAME, "root_kind", F.least("src_o", "dst_o").alias("a_o"), F.greatest("src_o", "dst_o").alias("b_o")).distinct()
    side = lambda p: t.o.select(*FRAME, F.col("idx").alias(f"{p}_o"), *(F.col(k).alias(f"{p}_{k}") for k in "xyz"))
    return pairs.join(side("a"), [*FRAME, "a_o"]).join(side("b"), [*FRAME, "b_o"])


def hb_ratio_data(t, cutoff: float = 2.9, window: int | None = None, dt: float = 0.0005) -> DataFrame:
    r = t.hb_ratio(cutoff)
    for c in ("oh_ratio", "h3o_ratio", "total_ratio"):
        r = stats.hull(r, c, window, out=f"{c}_hma") if window else r
    return time_axis(r, dt)


def hb_wire_data(t, cutoff: float = 2.9) -> DataFrame:
    """The oxygens of each wire in order, with places."""
    p = t.wires(cutoff).where("length > 0").select(*FRAME, F.posexplode("path").alias("k", "idx"))
    return p.join(t.o.select(*FRAME, "idx", "id", "x", "y", "z"), [*FRAME, "idx"])


def wire_length_data(t, cutoff: float = 2.9, start: int | None = None, stop: int | None = None) -> DataFrame:
    return hbonds.length_histogram(t.wires(cutoff), 10, start, stop)


def hb_distances_data(t, cutoff: float = 2.9) -> DataFrame:
    """Mean wire distances with the island of frames they belong to."""
    i = hbonds.islands(t.wires(cutoff)).select("trajectory_id", "island", "start", "end")
    return t.wire_distances(cutoff).join(i, "trajectory_id").where("snapshot BETWEEN start AND end").select(*FRAME, "island", "mean_distance")


def transition_data(t, root: str = "h3o", cutoff: float = 3.0) -> DataFrame:
    c = t.transition_ions(root, cutoff).select(*FRAME, "ion", F.col("o_idx").alias("idx"), "n_h", "h_list")
    return c.join(t.o.select(*FRAME, "idx", "x", "y", "z"), [*FRAME, "idx"])


def water_hist_data(t) -> DataFrame:
    return t.water_histogram()
