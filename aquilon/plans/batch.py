"""Jobs over many trajectories in a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manipulate
from ..schema import FRAME
from ..sources import writers
from .trajectory import TrajectoryFrame


def averaged_rdf(spark: SparkSession, path: str, target: str, file_name: str, gr_types=("OH_ion", "H3O_ion"), n_bins: int = 50, stop: float = 8.0, format: str = "lammpstrj", save: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(mean g(r), recombination times) over all files `file_name` in folders whose name holds `target`, below path. Only trajectories
    that recombined count in the mean, each alike. One job reads and averages them all: partial sums are Spark's."""
    t = TrajectoryFrame.read(spark, path, format, file_name=file_name, target=target, **options).cache()
    g, times = t.averaged_rdf(gr_types, n_bins, stop=stop), t.recombination.where("did_recombine")
    if save:
        writers.write_rdf(g, save)
        writers.write_series(times.select(F.col("recombination_time").alias("value"), F.col("trajectory_id").alias("pos")), f"{save}/recombination_times")
    return g, times


def generate_inputs(t: TrajectoryFrame, out: str, n: int = 1, least: float = 0.2, most: float = 0.4, seed: int = 0) -> DataFrame:
    """n starting frames as data files in out/copy=k: of every first frame a copy with a displaced hydrogen, at a distance drawn by
    seed between least and most."""
    made = None
    for k in range(n):  # the number of files asked for
        d = least + (most - least) * ((seed * 7919 + k * 104729) % 1000) / 999
        one = manipulate.displace(t, 0, None, target=d, eps=0.05, seed=seed + k).withColumn("copy", F.lit(k))
        made = one if made is None else made.unionByName(one)
    lines = None
    for k in range(n):
        f = writers.data_lines(made.where(F.col("copy") == k).drop("copy"), t.frames.where("snapshot = 0")).withColumn("copy", F.lit(k))
        lines = f if lines is None else lines.unionByName(f)
    lines.repartition("copy", "trajectory_id").sortWithinPartitions("copy", *FRAME, "seq").select("copy", "trajectory_id", "value").write.mode("overwrite").partitionBy("copy", "trajectory_id").text(out)
    return made


def fill_hydroxides(spark: SparkSession, path: str, out: str, coords: str = "cartesian", angle: float = 104.5, length: float = 0.96, seed: int = 0) -> TrajectoryFrame:
    """Data files with the missing hydrogen added, as out/trajectory_id=k."""
    t = TrajectoryFrame.read(spark, path, "lammps_data", coords=coords).fill_hydroxide(0, angle, length, seed)
    lines = writers.data_lines(t.atoms, t.frames)
    lines.repartition("trajectory_id").sortWithinPartitions("trajectory_id", "seq").select("trajectory_id", "value").write.mode("overwrite").partitionBy("trajectory_id").text(out)
    return t
