"""Text and array formats to (atoms, frames). Every reader is lazy and splits files into frames with Spark's own text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import wrap_once
from ..schema import FRAME

_NUM = r"^\s*[-+]?[0-9]"
_EDGES = [("x", 0), ("y", 1), ("z", 2)]


def _text(spark: SparkSession, path, sep: str | None = None, file_name: str | None = None, target: str | None = None) -> DataFrame:
    """Rows (value, file): pieces between `sep`, or whole files. file_name: only files of that name, in any folder below;
    target: only where a folder's name holds it."""
    r = spark.read
    if file_name:
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
    t = r.text(path, wholetext=sep is None, lineSep=sep).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return t.where(F.exists(F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1), lambda d: d.contains(target))) if target else t


def _numbered(blocks: DataFrame, order: list) -> DataFrame:
    """trajectory_id by the order of file names, snapshot by the order of frames in a file."""
    files = blocks.select("file").distinct().withColumn("trajectory_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
    w = Window.partitionBy("file").orderBy(*order)
    return blocks.withColumn("snapshot", (F.row_number().over(w) - 1).cast("long")).join(files, "file")


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _normalise(atoms: DataFrame, frames: DataFrame, coords: str) -> DataFrame:
    """coords: scaled (wrap once), cartesian ((x - lo) / L, wrap once), cartesian_no_origin (x / L, wrap once), raw."""
    if coords == "raw":
        return atoms
    if coords not in ("scaled", "cartesian", "cartesian_no_origin"):
        raise ValueError(f"unknown coords {coords!r}")
    j = atoms.join(frames.select(*FRAME, "xlo", "ylo", "zlo", "lx", "ly", "lz"), FRAME) if coords != "scaled" else atoms
    for k in "xyz":
        v = F.col(k)
        v = v if coords == "scaled" else (v - F.col(f"{k}lo") if coords == "cartesian" else v) / F.col(f"l{k}")
        j = j.withColumn(k, wrap_once(v))
    return j.select(atoms.columns)


def rescaled(atoms: DataFrame, frames: DataFrame, coords: str = "cartesian_no_origin") -> DataFrame:
    """set_scale: brings coordinates in length units to scaled ones."""
    return _normalise(atoms, frames, coords)


def dump_blocks(text: DataFrame) -> DataFrame:
    """One row for each frame of a dump split at its first line: adds lines and timestep."""
    b = text.where(F.length(F.trim("value")) > 0).withColumn("lines", F.split(F.regexp_replace("value", r"\r?\n\s*$", ""), r"\r?\n"))
    return b.withColumn("timestep", F.trim(F.col("lines")[0]).cast("long"))


def dump_frames(b: DataFrame) -> DataFrame:
    """frames of dump blocks (trajectory_id, snapshot, timestep, lines, file)."""
    box = [_tokens(F.col("lines")[4 + i]) for i in range(3)]
    n = F.trim(F.col("lines")[2]).cast("int")
    tilt = F.exists(F.array(*(F.try_element_at(t, F.lit(3)).cast("double") for t in box)), lambda v: F.coalesce(v != 0, F.lit(False)))
    return b.select(
        "trajectory_id", "snapshot", "timestep", n.alias("n_atoms"),
        *(box[i][j].cast("double").alias(f"{k}{s}") for k, i in _EDGES for j, s in ((0, "lo"), (1, "hi"))),
        *(F.abs(box[i][0].cast("double") - box[i][1].cast("double")).alias(f"l{k}") for k, i in _EDGES),
        (F.size("lines") - 8 - n).alias("surplus"), tilt.alias("tilted"), "file",
    )


def dump_atoms(b: DataFrame, *more: Column) -> DataFrame:
    """Atom rows of dump blocks as written, with is_scaled by the header, and `more` columns made from a block."""
    n = F.trim(F.col("lines")[2]).cast("int")
    names = b.select(*more).columns if more else []
    rows = b.select("trajectory_id", "snapshot", *more, F.col("lines")[7].alias("header"), F.posexplode(F.slice("lines", F.lit(9), n)).alias("ord", "line")).withColumn("t", _tokens(F.col("line")))
    return rows.select(*FRAME, "ord", F.col("t")[0].cast("double").cast("long").alias("atom_id"), F.col("t")[1].cast("double").cast("int").alias("atom_type"), *(F.col("t")[2 + i].cast("double").alias(k) for k, i in _EDGES), F.col("header").rlike(r"\bxs\b").alias("is_scaled"), *names)


def read_dump(spark: SparkSession, path, coords: str | None = None, snapshot: int | None = None, file_name: str | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dump files, one row for each frame before parsing.

    The first five columns are id, type, x, y, z. coords: None reads the header (xs: scaled, else cartesian). The declared number of
    atoms counts; frames.surplus says how many rows stood beyond it. Frames are numbered by time step, then place.
    A third column of box bounds (tilt) is kept as frames.tilted; boxes are taken as orthogonal. snapshot: only that frame.
    """
    b = _numbered(dump_blocks(_text(spark, path, "ITEM: TIMESTEP\n", file_name, target)), ["timestep", "at"])
    if snapshot is not None:
        b = b.where(F.col("snapshot") == snapshot)
    frames, atoms = dump_frames(b), dump_atoms(b)
    if coords is not None:
        return _normalise(atoms.drop("is_scaled"), frames, coords), frames
    j = atoms.join(frames.select(*FRAME, "xlo", "ylo", "zlo", "lx", "ly", "lz"), FRAME)
    for k in "xyz":
        j = j.withColumn(k, wrap_once(F.when(F.col("is_scaled"), F.col(k)).otherwise((F.col(k) - F.col(f"{k}lo")) / F.col(f"l{k}"))))
    return j.select(*FRAME, "ord", "atom_id", "atom_type", "x", "y", "z"), frames


def read_data_file(spark: SparkSession, path, coords: str = "cartesian", file_name: str | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Data files (one frame each): the header's count and box lines, then the Atoms section wherever it starts; comments after # go."""
    b = _numbered(_text(spark, path, None, file_name, target), ["at"])
    b = b.withColumn("lines", F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"#.*$", ""))))
    start = F.array_position(F.transform("lines", lambda s: s.rlike(r"^Atoms\b")), F.lit(True)).cast("int")
    n = F.regexp_extract("value", r"(?m)^\s*(\d+)\s+atoms\b", 1).cast("int")
    lim = {k: [F.regexp_extract("value", rf"(?m)^\s*(\S+)\s+(\S+)\s+{k}lo\s+{k}hi", g).cast("double") for g in (1, 2)] for k in "xyz"}
    frames = b.select(
        "trajectory_id", "snapshot", F.lit(0).cast("long").alias("timestep"), n.alias("n_atoms"),
        *(lim[k][j].alias(f"{k}{s}") for k in "xyz" for j, s in ((0, "lo"), (1, "hi"))), *(F.abs(lim[k][0] - lim[k][1]).alias(f"l{k}") for k in "xyz"), "file",
    )
    body = F.filter(F.slice("lines", start + 1, F.greatest(F.size("lines") - start, F.lit(0))), lambda s: s.rlike(_NUM))
    rows = b.select("trajectory_id", "snapshot", F.posexplode(F.slice(body, F.lit(1), n)).alias("ord", "line")).withColumn("t", _tokens(F.col("line")))
    atoms = rows.select(*FRAME, "ord", F.col("t")[0].cast("double").cast("long").alias("atom_id"), F.col("t")[1].cast("double").cast("int").alias("atom_type"), *(F.col("t")[2 + i].cast("double").alias(k) for k, i in _EDGES))
    return _normalise(atoms, frames, coords), frames


def read_xdatcar(spark: SparkSession, path, coords: str = "scaled", file_name: str | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """XDATCAR files: species from the names and counts of the header (H is type 1, O type 2, others 0), ids by place; the box is the
    diagonal of the lattice, times the scale line."""
    t = _text(spark, path, "Direct", file_name, target).withColumn("lines", F.filter(F.split("value", r"\r?\n"), lambda s: F.length(F.trim(s)) > 0))
    is_head = ~F.col("value").rlike(r"^\s*configuration")
    head = t.where(is_head & (F.size("lines") >= 7)).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where("k = 1")
    counts = F.transform(_tokens(F.col("lines")[6]), lambda s: s.cast("int"))
    scale = F.trim(F.col("lines")[1]).cast("double")
    head = head.select("file", *((_tokens(F.col("lines")[2 + i])[i].cast("double") * scale).alias(f"l{k}") for k, i in _EDGES), _tokens(F.col("lines")[5]).alias("names"), counts.alias("counts"), F.aggregate(counts, F.lit(0), lambda a, v: a + v).alias("n_atoms"))
    step = F.regexp_extract(F.col("value"), r"^\s*configuration=\s*(\d+)", 1)
    b = _numbered(t.where(~is_head).withColumn("timestep", F.when(step == "", F.lit(0)).otherwise(step.cast("long"))), ["timestep", "at"]).join(head, "file")
    frames = b.select("trajectory_id", "snapshot", "timestep", "n_atoms", *(F.lit(0.0).alias(f"{k}lo") if s == "lo" else F.col(f"l{k}").alias(f"{k}hi") for k in "xyz" for s in ("lo", "hi")), "lx", "ly", "lz", "file")
    kinds = F.flatten(F.transform(F.arrays_zip("names", "counts"), lambda p: F.array_repeat(F.when(p["names"] == "H", 1).when(p["names"] == "O", 2).otherwise(0), p["counts"])))
    rows = b.select("trajectory_id", "snapshot", kinds.alias("kinds"), F.posexplode(F.slice("lines", F.lit(2), F.col("n_atoms"))).alias("ord", "line")).withColumn("t", _tokens(F.col("line")))
    atoms = rows.select(*FRAME, "ord", (F.col("ord") + 1).cast("long").alias("atom_id"), F.col("kinds")[F.col("ord")].cast("int").alias("atom_type"), *(F.col("t")[i].cast("double").alias(k) for k, i in _EDGES))
    return _normalise(atoms, frames, coords), frames


def read_gro(spark: SparkSession, path, coords: str = "cartesian", unit: float = 1.0, file_name: str | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """gro files whose frames start with Generated; names beginning with O are type 2, with H type 1; coordinates times `unit`."""
    t = _text(spark, path, "Generated", file_name, target).where(F.length(F.trim("value")) > 0)
    t = t.withColumn("lines", F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).where(F.size("lines") > 2)
    b = _numbered(t.withColumn("time", F.regexp_extract("value", r"t=\s*([0-9.eE+-]+)", 1).try_cast("double")), ["time", "at"]).withColumn("n_atoms", F.trim(F.col("lines")[1]).cast("int"))
    box = F.transform(_tokens(F.element_at("lines", F.col("n_atoms") + 3)), lambda s: s.cast("double") * unit)
    frames = b.select("trajectory_id", "snapshot", F.col("snapshot").alias("timestep"), "n_atoms", *(F.lit(0.0).alias(f"{k}lo") if s == "lo" else box[i].alias(f"{k}hi") for k, i in _EDGES for s in ("lo", "hi")), *(box[i].alias(f"l{k}") for k, i in _EDGES), "file")
    rows = b.select("trajectory_id", "snapshot", F.posexplode(F.slice("lines", F.lit(3), F.col("n_atoms"))).alias("ord", "line"))
    name = F.trim(F.substring("line", 11, 5))
    xyz = [(F.trim(F.substring("line", 21 + 8 * i, 8)).cast("double") * unit).alias(k) for k, i in _EDGES]
    kind = F.when(name.startswith("O"), 2).when(name.startswith("H"), 1).otherwise(0).cast("int")
    atoms = rows.select(*FRAME, "ord", (F.col("ord") + 1).cast("long").alias("atom_id"), kind.alias("atom_type"), *xyz)
    return _normalise(atoms, frames, coords), frames


def read_npz(spark: SparkSession, path: str, coords: str = "raw") -> tuple[DataFrame, DataFrame]:
    """An array archive (atom_list (T, N, 5), box_dim (T, 3, 2), n_atoms) of one trajectory, through the driver; meant for
    small files, read_cache() for the rest."""
    import numpy as np
    import pyarrow as pa

    z = np.load(path)
    a, box = np.asarray(z["atom_list"], float), np.asarray(z["box_dim"], float)
    t, n = a.shape[:2]
    cols = {"trajectory_id": np.zeros(t * n, np.int64), "snapshot": np.repeat(np.arange(t), n), "ord": np.tile(np.arange(n, dtype=np.int32), t), "atom_id": a[..., 0].ravel().astype(np.int64), "atom_type": a[..., 1].ravel().astype(np.int32)}
    cols |= {k: a[..., 2 + i].ravel() for k, i in _EDGES}
    f = {"trajectory_id": np.zeros(t, np.int64), "snapshot": np.arange(t), "timestep": np.arange(t), "n_atoms": np.full(t, n, np.int32)}
    f |= {f"{k}{s}": box[:, i, j] for k, i in _EDGES for j, s in ((0, "lo"), (1, "hi"))} | {f"l{k}": np.abs(box[:, i, 0] - box[:, i, 1]) for k, i in _EDGES}
    atoms, frames = spark.createDataFrame(pa.table(cols)), spark.createDataFrame(pa.table(f))
    return _normalise(atoms, frames, coords), frames


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_cache() wrote; filters on trajectory_id prune folders, filters on snapshot prune row groups."""
    return spark.read.parquet(f"{path}/atoms"), spark.read.parquet(f"{path}/frames")


def read_rdf(spark: SparkSession, path: str, suffix: str = "_RDF_averaged.csv") -> DataFrame:
    """Two-row files [g; r] named <label><suffix>: label, bin, r, g."""
    named = r"([^/]*)" + suffix.replace(".", r"\.") + r"(?:/[^/]*)?$"  # a file, or a folder of one part
    t = _text(spark, path, None, "*").where(F.col("file").rlike(named)).withColumn("rows", F.split(F.trim("value"), r"\r?\n"))
    num = lambda i: F.transform(F.split(F.col("rows")[i], ","), lambda s: F.trim(s).cast("double"))
    label = F.regexp_extract("file", named, 1)
    return t.select(label.alias("label"), F.posexplode(F.arrays_zip(num(0).alias("g"), num(1).alias("r"))).alias("bin", "p")).select("label", "bin", "p.r", "p.g")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """One number a line: pos, value."""
    v = spark.read.schema("value DOUBLE").csv(path).select("value", F.monotonically_increasing_id().alias("at"))
    return v.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("pos"), "value")
