"""Registered queries that write the derived trajectories in a format to the shared scratch folder and read them back: sources and
sinks against the SQL of the rows they hold."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manipulate
from ..schema import FRAME
from ..session import scratch_dir
from ..sources import readers, writers
from .queries import _AM, _ALL, _MEAN, REACH, L, _ion_rdf, _pairs, _query, _r, _rdf_sql, r6, sql, trajectory
from .trajectory import TrajectoryFrame


def _folder(spark: SparkSession) -> str:
    path = f"{scratch_dir(spark)}/aquilon-io-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def _back(tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Atoms under the trajectory's number in the folder's name (readers number files by name)."""
    atoms, frames = tables
    real = frames.select(*FRAME, F.regexp_extract("file", r"trajectory_id=(\d+)", 1).cast("long").alias("real"))
    return atoms.join(real, FRAME).select(F.col("real").alias("trajectory_id"), "snapshot", "ord", "atom_id", "atom_type", "x", "y", "z")


def _shown(atoms: DataFrame) -> DataFrame:
    return atoms.select(*FRAME, "ord", "atom_id", "atom_type", *(_r(k) for k in "xyz"))


def _atoms_sql(scale: str = "", where: str = "", order: str = "ord", ids: str = "atom_id", snapshot: str = "snapshot") -> str:
    return sql(f"SELECT trajectory_id, {snapshot}, CAST({order} AS INT) AS ord, CAST({ids} AS BIGINT) AS atom_id, atom_type, {', '.join(f'{r6(f"{k}{scale}")} AS {k}' for k in 'xyz')} FROM atoms {where}")


_SORTED = "row_number() OVER (PARTITION BY trajectory_id, snapshot ORDER BY atom_type {d}, ord)"


def _dump(spark, sf, scaled: bool = True, **how) -> DataFrame:
    t, path = trajectory(spark, sf), _folder(spark)
    writers.write_dump(t.atoms, t.frames, path, by="trajectory_id", scaled=scaled)
    return _shown(_back(readers.read_dump(spark, path, file_name="part-*", target="trajectory_id=", **how)))


@_query(_atoms_sql())
def io_dump_scaled(spark, sf):
    return _dump(spark, sf)


@_query(_atoms_sql())
def io_dump_cartesian(spark, sf):
    return _dump(spark, sf, False)


@_query(_atoms_sql())
def io_dump_wrapped(spark, sf):
    return _dump(spark, sf, coords="scaled")


@_query(_atoms_sql())
def io_dump_without_origin(spark, sf):
    return _dump(spark, sf, False, coords="cartesian_no_origin")


@_query(_atoms_sql(f" * {L}"))
def io_dump_raw(spark, sf):
    return _dump(spark, sf, False, coords="raw")


@_query(_atoms_sql(where="WHERE snapshot = 3"))
def io_dump_one_snapshot(spark, sf):
    return _dump(spark, sf, snapshot=3)


@_query(_atoms_sql())
def io_set_scale(spark, sf):
    """Raw length units, brought to scaled ones afterwards."""
    t, path = trajectory(spark, sf), _folder(spark)
    writers.write_dump(t.atoms, t.frames, path, by="trajectory_id", scaled=False)
    atoms, frames = readers.read_dump(spark, path, coords="raw", file_name="part-*")
    return _shown(_back((readers.rescaled(atoms, frames), frames)))


@_query(sql("SELECT DISTINCT trajectory_id, snapshot, snapshot AS timestep, CAST(81 AS INT) AS n_atoms, CAST(0 AS INT) AS surplus, false AS tilted FROM atoms"))
def io_dump_frames(spark, sf):
    t, path = trajectory(spark, sf), _folder(spark)
    writers.write_dump(t.atoms, t.frames, path, by="trajectory_id")
    f = TrajectoryFrame.read(spark, path, "lammpstrj", file_name="part-*").frames
    return f.select(F.regexp_extract("file", r"trajectory_id=(\d+)", 1).cast("long").alias("trajectory_id"), "snapshot", "timestep", "n_atoms", "surplus", "tilted")


@_query(_atoms_sql(where="WHERE snapshot = 1", order=_SORTED.format(d="") + " - 1", ids=_SORTED.format(d=""), snapshot="CAST(0 AS BIGINT) AS snapshot"))
def io_data_file(spark, sf):
    t, path = trajectory(spark, sf).at(1), _folder(spark)
    writers.write_lines(writers.data_lines(t.atoms, t.frames), path, "trajectory_id")
    return _shown(_back(TrajectoryFrame.read(spark, path, "lammps_data", file_name="part-*").tables()))


@_query(_atoms_sql(order=_SORTED.format(d="DESC") + " - 1", ids=_SORTED.format(d="DESC")))
def io_xdatcar(spark, sf):
    t, path = trajectory(spark, sf), _folder(spark)
    writers.write_xdatcar(t.atoms, t.frames, path, by="trajectory_id")
    return _shown(_back(TrajectoryFrame.read(spark, path, "XDATCAR", file_name="part-*").tables()))


@_query(sql(f"SELECT trajectory_id, snapshot, ord, atom_id, atom_type, {', '.join(f'round({k} * {L}, 5) + 0e0 AS {k}' for k in 'xyz')} FROM atoms"))
def io_gro(spark, sf):
    """The format's fixed columns, five decimals."""
    t, path = trajectory(spark, sf), _folder(spark)
    a = t.atoms.withColumn("name", F.when(F.col("atom_type") == 2, "OW").otherwise("HW"))
    cell = lambda c: F.lpad(F.format_number(c, 5), 8, " ")
    line = F.concat(F.lit("    1SOL  "), F.lpad("name", 5, " "), F.lpad(F.col("atom_id").cast("string"), 5, " "), *(cell(F.col(k) * 9.3) for k in "xyz"))
    head = t.frames.select(*FRAME, F.posexplode(F.array(F.concat(F.lit("Generated by a test : t= "), F.col("snapshot").cast("string")), F.col("n_atoms").cast("string"))).alias("k", "value"))
    lines = head.select(*FRAME, (F.col("k") - 10).cast("long").alias("seq"), "value").unionByName(a.select(*FRAME, F.col("ord").cast("long").alias("seq"), line.alias("value")))
    lines = lines.unionByName(t.frames.select(*FRAME, F.lit(10**6).cast("long").alias("seq"), F.concat_ws(" ", "lx", "ly", "lz").alias("value")))
    writers.write_lines(lines, path, "trajectory_id")
    got = _back(TrajectoryFrame.read(spark, path, "gromac", coords="raw", file_name="part-*").tables())
    return got.select(*FRAME, "ord", "atom_id", "atom_type", *((F.round(k, 5) + 0.0).alias(k) for k in "xyz"))


@_query(_atoms_sql())
def io_cache(spark, sf):
    t, path = trajectory(spark, sf), _folder(spark)
    t.write(path, "parquet")
    return _shown(TrajectoryFrame.read(spark, path, "parquet").atoms)


@_query(_rdf_sql(_pairs("o", "o"), "27e0", 27, _ALL, f"SELECT 'OO' AS gr_type, b AS bin, {r6('avg(r)')} AS r, {r6('avg(g)')} AS g FROM (SELECT g.t, b, avg(r) AS r, avg(g) AS g FROM g JOIN rec ON rec.t = g.t AND rec.did GROUP BY g.t, b) GROUP BY b", "OO"))
def io_rdf_csv(spark, sf):
    path = _folder(spark)
    writers.write_rdf(trajectory(spark, sf).averaged_rdf(("OO",), stop=4.65), path)
    return readers.read_rdf(spark, f"{path}/*").select(F.col("label").alias("gr_type"), "bin", _r("r"), _r("g"))


@_query(sql("SELECT row_number() OVER (ORDER BY t) - 1 AS pos, CAST(rt AS DOUBLE) AS value FROM rec"))
def io_series_csv(spark, sf):
    path = _folder(spark)
    writers.write_series(trajectory(spark, sf).recombination_time().select(F.col("recombination_time").alias("value"), F.col("trajectory_id").alias("pos")), path)
    return readers.read_series(spark, path)


@_query(sql("SELECT a.t AS trajectory_id, a.s AS snapshot, CAST(row_number() OVER (PARTITION BY a.t, a.s ORDER BY ty DESC, b.ord) - 1 AS INT) AS ord, a.id AS atom_id, CAST(ty AS INT) AS atom_type FROM am a JOIN mol m ON m.t = a.t AND m.s = a.s AND m.o = a.mol JOIN atoms b ON b.trajectory_id = a.t AND b.snapshot = a.s AND b.atom_id = a.id WHERE a.s = 2 AND NOT (m.id IN (9, 30) AND m.n_h > 0)", "", _AM).replace("a.s AS snapshot", "CAST(0 AS BIGINT) AS snapshot"))
def io_removed_dump(spark, sf):
    """Two molecules removed, written with the oxygens first at time step 0."""
    t, path = trajectory(spark, sf).remove_molecules(snapshot=2, o_ids=[9, 30]), _folder(spark)
    writers.write_dump(t.atoms, t.frames, path, timestep=0, by="trajectory_id", oxygens_first=True)
    return _back(readers.read_dump(spark, path, file_name="part-*")).drop("x", "y", "z")


@_query(sql("SELECT t AS trajectory_id, s AS snapshot, id AS atom_id FROM o JOIN (SELECT net.t, net.s, u AS o FROM net UNION SELECT t, s, v FROM net) n USING (t, s, o)", REACH))
def network_atoms(spark, sf):
    """The atoms of both ion networks as a frame of their own."""
    t = trajectory(spark, sf)
    net = t.hbond_network("oh", 3.2).unionByName(t.hbond_network("h3o", 3.2)).select(*FRAME, F.explode(F.array("src_o", "dst_o")).alias("idx")).distinct()
    ids = net.join(t.o.select(*FRAME, "idx", F.col("id").alias("atom_id")), [*FRAME, "idx"]).select(*FRAME, "atom_id")
    return manipulate.select_atoms(t, ids).select(*FRAME, "atom_id")


def _both_ions() -> str:
    kind = lambda k, name: _ion_rdf(k, name).replace(_MEAN.format(name=name), f"SELECT '{name}' AS gr_type, b AS bin, {r6('avg(r)')} AS r, {r6('avg(g)')} AS g FROM (SELECT g.t, b, avg(r) AS r, avg(g) AS g FROM g JOIN rec ON rec.t = g.t AND rec.did GROUP BY g.t, b) GROUP BY b")
    return f"SELECT * FROM ({kind('oh', 'OH_ion')}) UNION ALL SELECT * FROM ({kind('h3o', 'H3O_ion')})"


@_query(_both_ions())
def rdf_averaged_ions(spark, sf):
    return trajectory(spark, sf).averaged_rdf(("OH_ion", "H3O_ion"), stop=4.65).select("gr_type", "bin", _r("r"), _r("g"))


@_query(_rdf_sql(_pairs("o", "o"), "27e0", 27, _ALL, _MEAN, "OO"))
def rdf_by_increment(spark, sf):
    return trajectory(spark, sf).rdf_by_increment("OO", (4.65 - 0.01) / 49, stop=4.65).select("trajectory_id", "gr_type", "bin", _r("r"), _r("g"))


@_query(sql("SELECT t AS trajectory_id, count(*) * 3 - 12 AS n_atoms FROM mol WHERE s = 9 GROUP BY t"))
def remove_molecules_drawn(spark, sf):
    """Four waters drawn by seed: which ones is the generator's, that whole waters go isn't."""
    left = trajectory(spark, sf).remove_molecules(4, 9, seed=3)
    return left.frames.select("trajectory_id", F.col("n_atoms").cast("long").alias("n_atoms"))


@_query(sql("SELECT t AS trajectory_id, count(*) AS n_o, CAST(sum(n_h) AS BIGINT) + 1 AS n_h, CAST(3 * count(*) AS BIGINT) + 1 AS n_atoms FROM mol WHERE s = 2 GROUP BY t"))
def fill_hydroxide_counts(spark, sf):
    f = trajectory(spark, sf).fill_hydroxide(2)
    return f.counts.join(f.frames.select(*FRAME, F.col("n_atoms").cast("long").alias("n_atoms")), FRAME).select("trajectory_id", "n_o", "n_h", "n_atoms")
