"""Trajectories that grow: dump files arriving in a folder as a stream of whole frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import wrap_once
from ..plans.trajectory import TrajectoryFrame
from ..sources.readers import dump_atoms, dump_blocks, dump_frames


def dump_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A streaming row for each frame (its lines and timestep). trajectory_id is a hash of the file's name, snapshot the timestep.
    A file counts once it is complete, as in every file source."""
    t = spark.readStream.option("lineSep", "ITEM: TIMESTEP\n").option("maxFilesPerTrigger", max_files).text(path)
    b = dump_blocks(t.select("value", F.col("_metadata.file_path").alias("file")))
    return b.select(F.xxhash64("file").alias("trajectory_id"), F.col("timestep").alias("snapshot"), "timestep", "lines", "file")


def tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of rows from dump_stream(), on a stream or a micro-batch. All lines of a frame stand in one row, so this needs
    no state and no shuffle."""
    frames = dump_frames(blocks)
    edge = lambda i, j: F.split(F.trim(F.col("lines")[4 + i]), r"\s+")[j].cast("double")
    atoms = dump_atoms(blocks, *(edge(i, j).alias(f"{k}{'lo' if j == 0 else 'hi'}") for i, k in enumerate("xyz") for j in (0, 1)))
    for k in "xyz":  # as the batch reader does it, with the box in the row
        v = F.when(F.col("is_scaled"), F.col(k)).otherwise((F.col(k) - F.col(f"{k}lo")) / F.abs(F.col(f"{k}hi") - F.col(f"{k}lo")))
        atoms = atoms.withColumn(k, wrap_once(v))
    return atoms.select("trajectory_id", "snapshot", "ord", "atom_id", "atom_type", "x", "y", "z"), frames


def each_batch(blocks: DataFrame, use: Callable[[TrajectoryFrame, int], None]) -> DataStreamWriter:
    """Runs a batch analysis on the complete frames of every micro-batch (analyses within frames only)."""

    def step(batch: DataFrame, number: int) -> None:
        use(TrajectoryFrame(*tables(batch)), number)

    return blocks.writeStream.foreachBatch(step)


def jumps(track: DataFrame) -> DataFrame:
    """Jumps along a stream of (trajectory_id, snapshot, ion_id): a row for each frame whose ion sits on another particle than
    in the frame before. State: the last frame of each trajectory; frames must not arrive before earlier ones' batch."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("snapshot")
        out = []
        for snap, ion in zip(rows["snapshot"], rows["ion_id"]):
            if seen is not None and seen[1] != ion:
                out.append((key[0], seen[0], seen[1], ion))
            seen = (int(snap), int(ion))
        if seen is not None:
            state.update(seen)
        yield pd.DataFrame(out, columns=["trajectory_id", "snapshot", "ion_id", "next_id"])

    known = track.where("ion_id IS NOT NULL").select("trajectory_id", "snapshot", "ion_id")
    return known.groupBy("trajectory_id").applyInPandasWithState(step, "trajectory_id long, snapshot long, ion_id long, next_id long", "snapshot long, ion_id long", "append", GroupStateTimeout.NoTimeout)
