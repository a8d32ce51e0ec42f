"""A water trajectory derived from the events table: 27 waters in a cubic box of 9.3 A, ten frames a trajectory, one
proton that hops along a row of molecules in frames 0 to 7 and is home in frames 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

L = "9.3e0"


def _div(a: str, b: str) -> str:
    return f"CAST(floor(CAST({a} AS DOUBLE) / {b}) AS BIGINT)"


def atom_sql(shift: str = "0.45e0") -> tuple[str, list[str]]:
    """(source query over events, its columns as expressions): the same text runs on Spark and on other SQL engines."""
    source = (
        f"SELECT event_id, user_id, {_div('event_id', '81e0')} AS f, event_id % 81 AS slot, "
        "CAST((event_id * 7919) % 1009 AS DOUBLE) / 1009e0 - 0.5e0 AS ja, CAST((event_id * 104729 + user_id) % 1013 AS DOUBLE) / 1013e0 - 0.5e0 AS jb, "
        "CAST((event_id * 1299709) % 1019 AS DOUBLE) / 1019e0 - 0.5e0 AS jc FROM events "
        f"WHERE {_div('event_id', '81e0')} < (SELECT {_div('count(*)', '81e0')} FROM events)"
    )
    placed = (
        f"SELECT *, {_div('f', '10e0')} AS trajectory_id, f % 10 AS snapshot, {_div('slot', '3e0')} AS mol, slot % 3 AS part, "
        f"CASE WHEN f % 10 < 8 AND slot = 0 THEN 1 + 3 * {_div('(7 - f % 10)', '2e0')} ELSE {_div('slot', '3e0')} END AS host FROM ({source}) s0"
    )
    hop = "(host <> mol)"
    even = "((mol + snapshot) % 2 = 0)"
    dx = f"CASE WHEN part = 2 THEN 0e0 WHEN {hop} THEN -0.96e0 WHEN part = 0 AND {even} THEN 0.96e0 ELSE 0e0 END"
    dy = f"CASE WHEN part = 1 AND NOT {hop} THEN 0.96e0 ELSE 0e0 END"
    dz = f"CASE WHEN part = 0 AND NOT {hop} AND NOT {even} THEN 0.96e0 ELSE 0e0 END"
    at = {
        "x": f"(3.1e0 * CAST(host % 3 AS DOUBLE) + 1.55e0 + 0.3e0 * ja + {dx}) / {L} + {shift}",
        "y": f"(3.1e0 * CAST({_div('host', '3e0')} % 3 AS DOUBLE) + 1.55e0 + 0.3e0 * jb + {dy}) / {L} + {shift}",
        "z": f"(3.1e0 * CAST({_div('host', '9e0')} AS DOUBLE) + 1.55e0 + 0.3e0 * jc + {dz}) / {L} + {shift}",
    }
    cols = [
        "CAST(trajectory_id AS BIGINT) AS trajectory_id", "CAST(snapshot AS BIGINT) AS snapshot", "CAST(slot AS INT) AS ord", "CAST(slot + 1 AS BIGINT) AS atom_id",
        "CAST(CASE WHEN part = 2 THEN 2 ELSE 1 END AS INT) AS atom_type", *(f"{e} - floor({e}) AS {k}" for k, e in at.items()),
    ]
    return placed, cols


def full_sql(shift: str = "0.45e0") -> str:
    source, cols = atom_sql(shift)
    return f"SELECT {', '.join(cols)} FROM ({source}) s1"


def tables(spark: SparkSession, sf_dir: str, shift: str = "0.45e0") -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of the derived trajectories."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    atoms = spark.sql(full_sql(shift).replace("FROM events", "FROM {events}"), events=events)
    box = [F.lit(v).alias(k) for k, v in (("xlo", 0.0), ("xhi", 9.3), ("ylo", 0.0), ("yhi", 9.3), ("zlo", 0.0), ("zhi", 9.3), ("lx", 9.3), ("ly", 9.3), ("lz", 9.3))]
    frames = atoms.groupBy("trajectory_id", "snapshot").agg(F.count("*").cast("int").alias("n_atoms"))
    return atoms, frames.select("trajectory_id", "snapshot", F.col("snapshot").alias("timestep"), "n_atoms", *box)
