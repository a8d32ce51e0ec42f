"""New frames from old ones: replication, removal, displacement, repair. Random choices take a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axes, cross, displaced_hydrogen, distance, minus, norm, wrap_once
from ..schema import FRAME, HYDROGEN, OXYGEN


def _draw(seed: int, *cols):
    return F.xxhash64(F.lit(seed), *cols)


def expand(t, snapshot: int = 0, remove_ions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Eight copies of a frame side by side, in length units, with new ids from 0 (copies in the order of dx, dy, dz, rows by type
    and order inside) and doubled box edges. remove_ions: molecules without exactly two hydrogens are left out."""
    a = t.atoms_with_molecule.where(F.col("snapshot") == snapshot)
    if remove_ions:
        a = a.where("n_h = 2")
    off = t.atoms.sparkSession.createDataFrame([(4 * i + 2 * j + k, float(i), float(j), float(k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)], "copy int, dx double, dy double, dz double")
    w = Window.partitionBy("trajectory_id").orderBy("copy", "atom_type", "ord")
    full = a.crossJoin(F.broadcast(off))  # eight offsets, a constant
    out = full.withColumn("new", F.row_number().over(w) - 1).select(
        *FRAME, F.col("new").cast("int").alias("ord"), F.col("new").cast("long").alias("atom_id"), "atom_type", *(((F.col(k) + F.col(f"d{k}")) * F.col(f"l{k}")).alias(k) for k in "xyz")
    )
    f = t.frames.where(F.col("snapshot") == snapshot)
    f = f.select(*FRAME, "timestep", F.col("n_atoms"), *(F.lit(0.0).alias(f"{k}lo") if s == "lo" else (2 * F.col(f"l{k}")).alias(f"{k}hi") for k in "xyz" for s in ("lo", "hi")), *((2 * F.col(f"l{k}")).alias(f"l{k}") for k in "xyz"))
    n = out.groupBy(*FRAME).agg(F.count("*").cast("int").alias("n_atoms"))
    return out, f.drop("n_atoms").join(n, FRAME).select("trajectory_id", "snapshot", "timestep", "n_atoms", *(c for c in f.columns if c not in ("trajectory_id", "snapshot", "timestep", "n_atoms")))


def remove_molecules(t, n: int = 1, snapshot: int = 0, o_ids: list[int] | None = None, seed: int = 0) -> DataFrame:
    """The atoms of a frame without n molecules (of those with a hydrogen) drawn by seed, or without those with the given oxygen ids."""
    a = t.atoms_with_molecule.where(F.col("snapshot") == snapshot)
    m = t.molecules.where((F.col("snapshot") == snapshot) & (F.col("n_h") > 0))
    if o_ids is not None:
        gone = m.where(F.col("o_id").isin([int(i) for i in o_ids]))
    else:
        w = Window.partitionBy(*FRAME).orderBy(_draw(seed, "o_id"), "o_id")
        gone = m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return a.join(gone.select(*FRAME, F.col("o_idx").alias("mol")), [*FRAME, "mol"], "left_anti").select(t.atoms.columns)


def remove_from_expanded(t, n: int, snapshot: int = 0, seed: int = 0, remove_ions: bool = True):
    """expand(), then remove_molecules() in the doubled box: a trajectory object in scaled coordinates."""
    from ..plans.trajectory import TrajectoryFrame

    a, f = expand(t, snapshot, remove_ions)
    s = a.join(f.select(*FRAME, "lx", "ly", "lz"), FRAME).select(*FRAME, "ord", "atom_id", "atom_type", *((F.col(k) / F.col(f"l{k}")).alias(k) for k in "xyz"))
    big = TrajectoryFrame(s, f)
    return TrajectoryFrame(remove_molecules(big, n, snapshot, None, seed), f)


def grouped(t) -> DataFrame:
    """All atoms ordered by molecule (hydrogens, then the oxygen) with the number of atoms of the molecule as type."""
    a = t.atoms_with_molecule
    w = Window.partitionBy(*FRAME).orderBy("mol", "atom_type", "ord")
    return a.select(*FRAME, (F.row_number().over(w) - 1).cast("int").alias("ord"), "atom_id", (F.col("n_h") + 1).cast("int").alias("atom_type"), "x", "y", "z")


def displace(t, snapshot: int = 0, o_idx: int | None = None, target: float = 0.05, eps: float = 0.01, seed: int = 0, copies: int = 1) -> DataFrame:
    """Moves the first hydrogen of one water: (copy, atoms). The reference oxygen is o_idx or drawn for each copy; the water is
    that with the smallest index at a direct scaled distance within eps of target. Its hydrogen goes to the other side of
    its oxygen. A copy without such a water is unchanged."""
    at = F.col("snapshot") == snapshot
    o = t.o.where(at)
    copy = t.atoms.sparkSession.range(copies).select(F.col("id").cast("int").alias("copy"))
    ref = o.crossJoin(F.broadcast(copy))  # a few copies, an argument
    if o_idx is not None:
        ref = ref.where(F.col("idx") == o_idx)
    else:
        w = Window.partitionBy("copy", *FRAME).orderBy(_draw(seed, "copy", "idx"), "idx")
        ref = ref.withColumn("r", F.row_number().over(w)).where("r = 1")
    ref = ref.select("copy", *FRAME, F.col("idx").alias("ref"), *(F.col(k).alias(f"r{k}") for k in "xyz"))
    pair = o.select(*FRAME, "idx", "x", "y", "z").join(ref, FRAME)
    d = distance(axes(), axes("r"))
    whole = t.molecules.where(at & (F.col("n_h") >= 2)).select(*FRAME, F.col("o_idx").alias("idx"), F.col("h_list")[0].alias("h1"), F.col("h_list")[1].alias("h2"))
    near = pair.where((F.col("idx") != F.col("ref")) & (d >= target - eps) & (d <= target + eps)).join(whole.select(*FRAME, "idx"), [*FRAME, "idx"])
    pick = near.groupBy("copy", *FRAME).agg(F.min("idx").alias("idx")).join(whole, [*FRAME, "idx"])
    side = lambda df, key, p: df.select(*FRAME, F.col("idx").alias(key), F.col("id").alias(f"{p}_id"), *(F.col(k).alias(f"{p}{k}") for k in "xyz"))
    h = t.h.where(at)
    p = pick.join(side(o, "idx", "o"), [*FRAME, "idx"]).join(side(h, "h1", "a"), [*FRAME, "h1"]).join(side(h, "h2", "b"), [*FRAME, "h2"])
    new = p.select("copy", *FRAME, F.col("a_id").alias("atom_id"), *(wrap_once(v).alias(f"n{k}") for k, v in zip("xyz", displaced_hydrogen(axes("a"), axes("b"), axes("o")))))
    every = t.atoms.where(at).crossJoin(F.broadcast(copy))
    j = every.join(new, ["copy", *FRAME, "atom_id"], "left")
    return j.select("copy", *FRAME, "ord", "atom_id", "atom_type", *(F.coalesce(f"n{k}", k).alias(k) for k in "xyz"))


def fill_hydroxide(t, snapshot: int = 0, angle: float = 104.5, length: float = 0.96, seed: int = 0) -> DataFrame:
    """The atoms of a frame with one hydrogen more on the first oxygen that has one: half of `angle` off the existing bond, turned
    about it at random (by seed), `length` away (over the longest edge, as coordinates are scaled)."""
    at = F.col("snapshot") == snapshot
    m = t.molecules.where(at & (F.col("n_h") == 1)).groupBy(*FRAME).agg(F.min(F.struct("o_idx", "h_list")).alias("m"))
    m = m.select(*FRAME, F.col("m.o_idx").alias("idx"), F.col("m.h_list")[0].alias("h"))
    j = m.join(t.o.select(*FRAME, "idx", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), "lx", "ly", "lz"), [*FRAME, "idx"])
    j = j.join(t.h.select(*FRAME, F.col("idx").alias("h"), *(F.col(k).alias(f"h{k}") for k in "xyz")), [*FRAME, "h"])
    b = [F.col(f"h{k}") - F.col(f"o{k}") for k in "xyz"]
    n = norm(b)
    u = [F.try_divide(x, n) for x in b]
    r = [F.pmod(_draw(seed, F.lit(i), *FRAME), F.lit(1_000_003)) / 1_000_003.0 - 0.5 for i in range(3)]
    q = cross(u, r)
    nq = norm(q)
    half = math.radians(angle / 2)
    step = F.lit(length) / F.greatest("lx", "ly", "lz")
    new = j.select(*FRAME, *((F.col(f"o{k}") + step * (math.cos(half) * a + math.sin(half) * F.try_divide(c, nq))).alias(k) for k, a, c in zip("xyz", u, q)))
    base = t.atoms.where(at)
    top = base.groupBy(*FRAME).agg(F.max("ord").alias("ord"), F.max("atom_id").alias("atom_id"))
    row = new.join(top, FRAME).select(*FRAME, (F.col("ord") + 1).cast("int").alias("ord"), (F.col("atom_id") + 1).alias("atom_id"), F.lit(HYDROGEN).alias("atom_type"), "x", "y", "z")
    return base.select(row.columns).unionByName(row)


def select_atoms(t, atom_ids: DataFrame) -> DataFrame:
    """Only the given atoms (trajectory_id, snapshot, atom_id)."""
    return t.atoms.join(atom_ids, [*FRAME, "atom_id"], "left_semi")


def labelled_network(t, cutoff: float = 2.9) -> DataFrame:
    """For each frame before recombination the oxygens of both ion networks: of the hydroxide's as type 2, of the hydronium's as
    1, then the hydroxide as 3 and the hydronium as 4. An oxygen in several comes several times."""
    net = t.hb_timeseries(cutoff)
    ends = net.select(*FRAME, "root_kind", F.explode(F.array("src_o", "dst_o")).alias("idx")).distinct()
    kind = F.when(F.col("root_kind") == "oh", 2).otherwise(1)
    a = ends.select(*FRAME, "idx", kind.alias("atom_type"), F.when(kind == 2, 0).otherwise(1).alias("block"))
    i = t.before(t.ions)
    for col, k, b in (("oh", 3, 2), ("h3o", 4, 3)):
        a = a.union(i.where(F.col(col).isNotNull()).select(*FRAME, col, F.lit(k), F.lit(b)))
    j = a.join(t.o.select(*FRAME, "idx", F.col("id").alias("atom_id"), "x", "y", "z"), [*FRAME, "idx"])
    w = Window.partitionBy(*FRAME).orderBy("block", "idx")
    return j.select(*FRAME, (F.row_number().over(w) - 1).cast("int").alias("ord"), "atom_id", F.col("atom_type").cast("int").alias("atom_type"), "x", "y", "z")
