"""Text formats from (atoms, frames). Lines are columns with a sort key; Spark writes them, replacing what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAME, HEADER_MASSES, HYDROGEN, OXYGEN


def _write(lines: DataFrame, path: str, single: bool, by: str | None = None) -> None:
    """lines: trajectory_id, snapshot, seq, value. Files in order; single: one file; by: one folder for each value of a column."""
    keys = ["trajectory_id", "snapshot", "seq"]
    if by:
        lines.repartition(by).sortWithinPartitions(by, *keys).select(by, "value").write.mode("overwrite").partitionBy(by).text(path)
        return
    out = lines.orderBy(*keys) if not single else lines.coalesce(1).sortWithinPartitions(*keys)
    out.select("value").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, by: str) -> None:
    """Any lines (trajectory_id, snapshot, seq, value), one folder for each value of a column: no task holds more than one of them needs."""
    _write(lines, path, False, by)


def _lines(frames: DataFrame, texts: list) -> DataFrame:
    return frames.select(*FRAME, F.posexplode(F.array(*texts)).alias("k", "value")).select(*FRAME, (F.col("k") - 1000).cast("long").alias("seq"), "value")


def data_lines(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """A data file's lines for each frame: 17 of header, then hydrogens from id 1, then oxygens, in length units."""
    n = atoms.groupBy(*FRAME).agg(F.count("*").alias("n"))
    f = frames.select(*FRAME, "lx", "ly", "lz").join(n, FRAME)
    edge = lambda k: F.concat(F.lit("   0.00000000       "), F.col(f"l{k}").cast("string"), F.lit(f"       {k}lo {k}hi"))
    # The layout of the header.
    text = [F.lit("translated LAMMPS data file via gromacsconf"), F.lit(""), F.concat(F.lit("       "), F.col("n").cast("string"), F.lit("  atoms")), F.lit("           2  atom types"), F.lit(""),
            edge("x"), edge("y"), edge("z"), F.lit("   0.00000000       0.00000000       0.00000000      xy xz yz"), F.lit(""), F.lit(" Masses"), F.lit(""),
            F.lit(f"           1   {HEADER_MASSES[0]}"), F.lit(f"           2   {HEADER_MASSES[1]}"), F.lit(""), F.lit(" Atoms"), F.lit("")]
    head = _lines(f, text)
    w = Window.partitionBy(*FRAME).orderBy(F.col("atom_type"), "ord")
    a = atoms.where(F.col("atom_type").isin(HYDROGEN, OXYGEN)).join(frames.select(*FRAME, "lx", "ly", "lz"), FRAME).withColumn("id", F.row_number().over(w))
    body = a.select(*FRAME, F.col("id").cast("long").alias("seq"), F.concat_ws(" ", "id", "atom_type", *(F.col(k) * F.col(f"l{k}") for k in "xyz")).alias("value"))
    return head.unionByName(body)


def write_data_file(atoms: DataFrame, frames: DataFrame, path: str, snapshot: int = 0) -> None:
    """One frame as a data file (cut_snapshot)."""
    at = F.col("snapshot") == snapshot
    _write(data_lines(atoms.where(at), frames.where(at)), path, True)


def write_data_files(atoms: DataFrame, frames: DataFrame, path: str, snapshots: list[int]) -> None:
    """Frames as data files, one folder for each: path/snapshot=k."""
    at = F.col("snapshot").isin([int(s) for s in snapshots])
    _write(data_lines(atoms.where(at), frames.where(at)), path, False, by="snapshot")


def dump_lines(atoms: DataFrame, frames: DataFrame, timestep: int | None = None, floats: bool = True, scaled: bool = True, oxygens_first: bool = False) -> DataFrame:
    """A dump's lines for each frame, atoms by ord, or oxygens before hydrogens; scaled coordinates or length units. TIMESTEP is the frame's own, or snapshot * timestep. The number of atoms is
    that of the rows. floats: ids and types as 1.0."""
    n = atoms.groupBy(*FRAME).agg(F.count("*").alias("n"))
    f = frames.join(n, FRAME)
    step = F.col("timestep") if timestep is None else F.col("snapshot") * timestep
    # The layout of the header.
    text = [F.lit("ITEM: TIMESTEP"), step.cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("n").cast("string"), F.lit("ITEM: BOX BOUNDS pp pp pp"),
            *(F.concat_ws(" ", f"{k}lo", f"{k}hi") for k in "xyz"), F.lit("ITEM: ATOMS id type xs ys zs" if scaled else "ITEM: ATOMS id type x y z")]
    kind = "double" if floats else "long"
    if not scaled:
        box = frames.select(*FRAME, *(F.col(c).alias(f"_{c}") for k in "xyz" for c in (f"{k}lo", f"l{k}")))
        atoms = atoms.join(box, FRAME).withColumns({k: F.col(k) * F.col(f"_l{k}") + F.col(f"_{k}lo") for k in "xyz"})
    if oxygens_first:
        atoms = atoms.withColumn("ord", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.col("atom_type").desc(), "ord")))
    body = atoms.select(*FRAME, F.col("ord").cast("long").alias("seq"), F.concat_ws(" ", F.col("atom_id").cast(kind), F.col("atom_type").cast(kind), "x", "y", "z").alias("value"))
    return _lines(f, text).unionByName(body)


def write_dump(atoms: DataFrame, frames: DataFrame, path: str, timestep: int | None = None, single: bool = True, by: str | None = None, scaled: bool = True, oxygens_first: bool = False) -> None:
    """by: a folder for each value of a column (trajectory_id: a file a trajectory), else one file or, in order, several."""
    _write(dump_lines(atoms, frames, timestep, scaled=scaled, oxygens_first=oxygens_first), path, single, by)


def write_xdatcar(atoms: DataFrame, frames: DataFrame, path: str, by: str | None = None) -> None:
    """Frames as XDATCAR, oxygens first, each with its header; by: a folder for each value of a column."""
    c = atoms.groupBy(*FRAME).agg(F.count(F.when(F.col("atom_type") == OXYGEN, 1)).alias("no"), F.count(F.when(F.col("atom_type") == HYDROGEN, 1)).alias("nh"))
    f = frames.join(c, FRAME)
    row = lambda i: F.concat_ws("    ", *(F.format_string("%.6f", F.col(f"l{k}")) if j == i else F.lit("0.000000") for j, k in enumerate("xyz")))
    text = [F.lit("unknown system"), F.lit("           1"), row(0), row(1), row(2), F.lit("    O    H"), F.concat_ws("   ", "no", "nh"), F.concat(F.lit("Direct configuration=     "), (F.col("snapshot") + 1).cast("string"))]
    w = Window.partitionBy(*FRAME).orderBy(F.col("atom_type").desc(), "ord")
    body = atoms.withColumn("seq", F.row_number().over(w).cast("long")).select(*FRAME, "seq", F.concat_ws(" ", "x", "y", "z").alias("value"))
    _write(_lines(f, text).unionByName(body), path, not by, by)


def write_cache(atoms: DataFrame, frames: DataFrame, path: str) -> None:
    """Parquet by trajectory, rows of a file sorted by frame."""
    for name, df in (("atoms", atoms), ("frames", frames)):
        keys = ["snapshot", "ord"] if name == "atoms" else ["snapshot"]
        df.repartition("trajectory_id").sortWithinPartitions("trajectory_id", *keys).write.mode("overwrite").partitionBy("trajectory_id").parquet(f"{path}/{name}")


def write_rdf(g: DataFrame, path: str, two_rows: bool = True) -> None:
    """g(r) (gr_type, bin, r, g): a folder <gr_type>_RDF_averaged.csv for each type with the rows [g; r], or one long CSV."""
    if not two_rows:
        g.write.mode("overwrite").option("header", True).csv(path)
        return
    s = g.groupBy("gr_type").agg(F.array_sort(F.collect_list(F.struct("bin", "g", "r"))).alias("p"))
    for (k,) in s.select("gr_type").distinct().collect():  # at most five kinds
        one = s.where(F.col("gr_type") == k).select(F.explode(F.array(F.array_join(F.col("p.g").cast("array<string>"), ","), F.array_join(F.col("p.r").cast("array<string>"), ","))).alias("value"))
        one.coalesce(1).write.mode("overwrite").text(f"{path}/{k}_RDF_averaged.csv")


def write_series(df: DataFrame, path: str, value: str = "value", order: str = "pos") -> None:
    """One number a line."""
    df.coalesce(1).sortWithinPartitions(order).select(value).write.mode("overwrite").csv(path)
