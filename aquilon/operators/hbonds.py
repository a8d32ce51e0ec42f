"""Hydrogen-bond networks: edges by joins, reachability and wires per frame."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import dot, image, norm
from ..schema import FRAME
from .neighbours import within

MAX_NEIGHBOURS = 19


def edges(o: DataFrame, h: DataFrame, assignment: DataFrame, cutoff: float = 3.6, min_angle: float = 150.0, as_written: bool = False) -> DataFrame:
    """Directed bonds donor src_o -> acceptor dst_o: both oxygens at periodic distance <= cutoff, the acceptor among the 19
    nearest of the donor, and the angle at the donor's hydrogen that is nearest to the acceptor (the first of equals) >=
    min_angle, its cosine rounded to five digits. A donor without hydrogen has no bond.

    as_written: the hydrogen's position inside its molecule is taken as its index in the frame, and the angle is that between
    donor - H and H - acceptor.
    """
    near = within(o, o, cutoff, same=True)
    rank = Window.partitionBy(*FRAME, "a_idx").orderBy("d2", "b_idx")
    near = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= MAX_NEIGHBOURS)
    near = near.select(*FRAME, "lx", "ly", "lz", F.col("a_idx").alias("src_o"), F.col("b_idx").alias("dst_o"), *(F.col(f"{s}_{k}").alias(f"{s}{k}") for s in "ab" for k in "xyz"))
    hy = h.select(*FRAME, F.col("idx").alias("h_idx"), *(F.col(k).alias(f"h{k}") for k in "xyz"))
    own = assignment.select(*FRAME, "h_idx", F.col("o_idx").alias("src_o")).join(hy, [*FRAME, "h_idx"])
    j = near.join(own, [*FRAME, "src_o"])
    d = [image((F.col(f"h{k}") - F.col(f"b{k}")) * F.col(f"l{k}"), F.col(f"l{k}")) for k in "xyz"]
    at = F.struct(*(F.col(f"h{k}").alias(k) for k in "xyz"))
    best = j.groupBy(*FRAME, "src_o", "dst_o").agg(
        F.min(F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"), "h_idx", at.alias("h"))).alias("m"),
        F.first(F.struct("lx", "ly", "lz", *(f"{s}{k}" for s in "ab" for k in "xyz"))).alias("p"),
    )
    if as_written:
        order = Window.partitionBy(*FRAME, "src_o").orderBy("h_idx")
        slot = own.withColumn("slot", (F.row_number().over(order) - 1).cast("int")).select(*FRAME, "src_o", "h_idx", "slot")
        best = best.select(*FRAME, "src_o", "dst_o", "p", F.col("m.h_idx").alias("h_idx")).join(slot, [*FRAME, "src_o", "h_idx"])
        best = best.join(hy.select(*FRAME, F.col("h_idx").alias("slot"), at.alias("hh")), [*FRAME, "slot"]).select(*FRAME, "src_o", "dst_o", "p", F.col("hh").alias("h"))
    else:
        best = best.select(*FRAME, "src_o", "dst_o", "p", F.col("m.h").alias("h"))
    # the hydrogen is moved to the middle of the box and the oxygens are wrapped once
    half = lambda v, e: F.when(v > e / 2, v - e).when(v < -e / 2, v + e).otherwise(v)
    to = lambda s: [half((F.col(f"p.{s}{k}") - F.col(f"h.{k}")) * F.col(f"p.l{k}"), F.col(f"p.l{k}")) for k in "xyz"]
    don, acc = to("a"), to("b")
    if as_written:
        acc = [-v for v in acc]
    cos = F.round(F.try_divide(dot(don, acc), norm(don) * norm(acc)), 5)
    return best.where(F.degrees(F.acos(cos)) >= min_angle).select(*FRAME, "src_o", "dst_o")


# ---------------------------------------------------------------- inside one frame


def _graph(src, dst):
    g: dict[int, list[int]] = {}
    for a, b in sorted(zip(src, dst)):
        g.setdefault(a, []).append(b)
    return g


def reached(src, dst, root) -> list[int]:
    """Vertices that directed edges reach from root, root first, in order of discovery."""
    if root is None or pd.isna(root):
        return []
    g, seen, todo = _graph(src, dst), {int(root): None}, deque([int(root)])
    while todo:
        for v in g.get(todo.popleft(), ()):
            if v not in seen:
                seen[v] = None
                todo.append(v)
    return list(seen)


def depth_first(src, dst, root) -> list[tuple[int, int]]:
    """Edges in the order of a stack search from root that expands each vertex once, children by index."""
    if root is None or pd.isna(root):
        return []
    g, mark, stack, out = _graph(src, dst), {int(root)}, [int(root)], []
    while stack:
        u = stack.pop()
        for v in g.get(u, ()):
            out.append((u, v))
            if v not in mark:
                mark.add(v)
                stack.append(v)
    return out


def shortest(src, dst, root, target) -> list[int] | None:
    """The path with the fewest edges from root to target; of several the one found first when children go by index."""
    if root is None or target is None or pd.isna(root) or pd.isna(target):
        return None
    g, seen, todo = _graph(src, dst), {int(root): None}, deque([int(root)])
    while todo:
        u = todo.popleft()
        if u == int(target):
            path = [u]
            while (u := seen[u]) is not None:
                path.append(u)
            return path[::-1]
        for v in g.get(u, ()):
            if v not in seen:
                seen[v] = u
                todo.append(v)
    return None


_PATH = T.ArrayType(T.IntegerType())
_BONDS = T.ArrayType(T.StructType([T.StructField("src_o", T.IntegerType()), T.StructField("dst_o", T.IntegerType())]))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _from_reached(src: pd.Series, dst: pd.Series, root: pd.Series) -> pd.Series:
    out = []
    for s, d, r in zip(src, dst, root):
        seen = set(reached(s, d, r))
        out.append([u in seen for u in s])
    return pd.Series(out, dtype=object)


@F.pandas_udf(_PATH)
def _shortest(src: pd.Series, dst: pd.Series, root: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([shortest(*x) for x in zip(src, dst, root, target)])


@F.pandas_udf(_BONDS)
def _ordered(src: pd.Series, dst: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series([[{"src_o": a, "dst_o": b} for a, b in depth_first(*x)] for x in zip(src, dst, root)])


def _frames(e: DataFrame, roots: DataFrame) -> DataFrame:
    """A row for each frame with its edge lists; a frame is bounded by its atoms, so batches of frames go to Python at once."""
    g = e.groupBy(*FRAME).agg(F.collect_list(F.struct("src_o", "dst_o")).alias("e"))
    return roots.join(g, FRAME, "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<src_o:int,dst_o:int>>")))


def network(e: DataFrame, ions: DataFrame, root: str) -> DataFrame:
    """The bonds that a search from an ion (oh or h3o) meets: those whose donor it reaches. As a set this does not depend on
    the order of the search."""
    return _nets(e, ions, root).select(*FRAME, F.lit(root).alias("root_kind"), F.inline("net"))


def _nets(e: DataFrame, ions: DataFrame, root: str) -> DataFrame:
    """A row for each frame with the ion `root`: its network's bonds as an array. The frame's bonds are read once."""
    f = _frames(e, ions.select(*FRAME, F.col(root).alias("root")).where("root IS NOT NULL"))
    f = f.withColumn("on", _from_reached(F.col("e.src_o"), F.col("e.dst_o"), F.col("root")))
    return f.select(*FRAME, "root", F.filter("e", lambda _, i: F.col("on")[i]).alias("net"))


def search_order(e: DataFrame, ions: DataFrame, root: str) -> DataFrame:
    """network() with the place `seq` of each bond in a depth-first search."""
    f = _frames(e, ions.select(*FRAME, F.col(root).alias("root"))).where("root IS NOT NULL AND size(e) > 0")
    x = f.select(*FRAME, F.posexplode(_ordered(F.col("e.src_o"), F.col("e.dst_o"), F.col("root"))).alias("seq", "p"))
    return x.select(*FRAME, F.lit(root).alias("root_kind"), "seq", "p.src_o", "p.dst_o")


def mirror_free(e: DataFrame) -> DataFrame:
    """Each undirected bond once, ends in ascending order."""
    return e.select(*FRAME, F.least("src_o", "dst_o").alias("a_o"), F.greatest("src_o", "dst_o").alias("b_o")).distinct()


def first_of_mirrors(e: DataFrame) -> DataFrame:
    """Of bonds that are equal or mirrored, the one with the smallest seq, direction kept."""
    w = Window.partitionBy(*FRAME, "root_kind", F.least("src_o", "dst_o"), F.greatest("src_o", "dst_o")).orderBy("seq")
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def wires(e: DataFrame, ions: DataFrame) -> DataFrame:
    """path (oxygen indices from h3o to oh over directed bonds, null where there is none) and length (its oxygens, else 0) for
    each row of ions."""
    f = _frames(e, ions.select(*FRAME, "oh", "h3o"))
    p = f.select(*FRAME, _shortest(F.col("e.src_o"), F.col("e.dst_o"), F.col("h3o"), F.col("oh")).alias("path"))
    return p.select(*FRAME, F.coalesce(F.size("path"), F.lit(0)).alias("length"), "path").withColumn("length", F.greatest("length", F.lit(0)))


def islands(w: DataFrame) -> DataFrame:
    """Runs of consecutive frames with a wire: island (numbered by its place), start, end, frames, is_open (touches the last frame)."""
    by = Window.partitionBy("trajectory_id").orderBy("snapshot")
    n = w.withColumn("pos", F.row_number().over(by)).withColumn("last", F.max("snapshot").over(Window.partitionBy("trajectory_id")))
    on = n.where("length > 0").withColumn("island", F.col("pos") - F.row_number().over(by))
    return on.groupBy("trajectory_id", "island").agg(F.min("snapshot").alias("start"), F.max("snapshot").alias("end"), F.count("*").alias("frames"), (F.max("snapshot") == F.first("last")).alias("is_open"))


def lifetimes(w: DataFrame, start: int | None = None, stop: int | None = None, include_open: bool = False) -> DataFrame:
    """Lengths of the islands in frames [start, stop); one that touches the end is left out unless include_open."""
    if start is not None:
        w = w.where(F.col("snapshot") >= start)
    if stop is not None:
        w = w.where(F.col("snapshot") < stop)
    i = islands(w)
    return (i if include_open else i.where("NOT is_open")).select("trajectory_id", "start", F.col("frames").alias("lifetime"))


def last_wire(w: DataFrame) -> DataFrame:
    """The wires of the last island."""
    i = islands(w).groupBy("trajectory_id").agg(F.max(F.struct("end", "start")).alias("m")).select("trajectory_id", "m.start", "m.end")
    return w.join(i, "trajectory_id").where("snapshot BETWEEN start AND end").select(*FRAME, "length", "path")


def wire_distances(w: DataFrame, o: DataFrame) -> DataFrame:
    """Mean periodic oxygen distance (length units) along each wire; null for a wire of one oxygen."""
    p = w.where("length > 0").select(*FRAME, "length", F.posexplode("path").alias("k", "idx"))
    c = p.join(o.select(*FRAME, "idx", "x", "y", "z", "lx", "ly", "lz"), [*FRAME, "idx"])
    by = Window.partitionBy(*FRAME).orderBy("k")
    d = [image((F.col(k) - F.lag(k).over(by)) * F.col(f"l{k}"), F.col(f"l{k}")) for k in "xyz"]
    s = c.withColumn("d", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return s.groupBy(*FRAME).agg(F.max("length").alias("length"), F.try_divide(F.sum("d"), F.max("length") - 1).alias("mean_distance"))


def length_histogram(w: DataFrame, bins: int = 10, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Equal-width bins of wire lengths from the least to the greatest of each trajectory, the last bin closed."""
    if start is not None:
        w = w.where(F.col("snapshot") >= start)
    if stop is not None:
        w = w.where(F.col("snapshot") < stop)
    lim = w.groupBy("trajectory_id").agg(F.min("length").cast("double").alias("lo"), F.max("length").cast("double").alias("hi"))
    lim = lim.select("trajectory_id", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = F.least(F.floor((F.col("length") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    n = w.join(lim, "trajectory_id").groupBy("trajectory_id", b.alias("bin")).agg(F.count("*").alias("n"))
    full = lim.select("trajectory_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return full.join(n, ["trajectory_id", "bin"], "left").select("trajectory_id", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def transition_ions(e: DataFrame, ions: DataFrame, mol: DataFrame, root: str = "h3o") -> DataFrame:
    """The bonded surroundings of an ion: for each frame with the ion the oxygens of its mirror-free bonds within its network,
    or the ion alone where the network has no bond; with the molecule of each (n_h, h_list)."""
    n = _nets(e, ions, root).withColumnRenamed("root", "ion")
    touch = F.filter("net", lambda b: (b["src_o"] == F.col("ion")) | (b["dst_o"] == F.col("ion")))
    ends = F.flatten(F.transform(touch, lambda b: F.array(b["src_o"], b["dst_o"])))
    near = F.when(F.size("net") == 0, F.array("ion")).otherwise(F.array_distinct(ends))
    return n.select(*FRAME, "ion", F.explode(near).alias("o_idx")).join(mol.select(*FRAME, "o_idx", "n_h", "h_list"), [*FRAME, "o_idx"]).select(*FRAME, "ion", "o_idx", "n_h", "h_list")


def bond_ratio(net: DataFrame, frames: DataFrame) -> DataFrame:
    """Bonds of each kind of root over the number of molecules (a third of the atoms, rounded down), and their total."""
    n = net.groupBy(*FRAME).agg(*(F.count(F.when(F.col("root_kind") == k, 1)).alias(k) for k in ("oh", "h3o")))
    j = frames.select(*FRAME, F.floor(F.col("n_atoms") / 3).alias("m")).join(n, FRAME, "left").na.fill(0, ["oh", "h3o"])
    return j.select(*FRAME, F.try_divide("oh", "m").alias("oh_ratio"), F.try_divide("h3o", "m").alias("h3o_ratio"), F.try_divide(F.col("oh") + F.col("h3o"), F.col("m")).alias("total_ratio"))
