"""Registered queries over the trajectories derived from events, each with the same result in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import axes, displaced_hydrogen, water_com, wrap_once
from ..operators import dynamics, hbonds, manipulate, neighbours, rdf, stats
from ..schema import FRAME, MASS_H, MASS_O
from ..sources import fixture, writers
from .trajectory import TrajectoryFrame

CUTOFF = 3.2  # A, gives frames with and without wires
STOP = 4.65
_HELD: dict = {}


def trajectory(spark: SparkSession, sf_dir: str, semantics: str = "documented") -> TrajectoryFrame:
    return TrajectoryFrame(*fixture.tables(spark, sf_dir), semantics)


def _r(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def _join(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        ORACLES[key] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL pieces

L = fixture.L


def img(d: str, box: str = L) -> str:
    return f"(CASE WHEN ({d}) >= {box} / 2e0 THEN ({d}) - {box} WHEN ({d}) < -{box} / 2e0 THEN ({d}) + {box} ELSE ({d}) END)"


def d2(a: str, b: str, scaled: bool = False, fold: bool = True, ca: str = "{}", cb: str = "{}") -> str:
    parts = []
    for k in "xyz":
        p, q = f"{a}.{ca.format(k)}", f"{b}.{cb.format(k)}"
        d = f"{p} - {q}" if scaled else f"{p} * {L} - {q} * {L}"
        parts.append(img(d, "1e0" if scaled else L) if fold else f"({d})")
    return " + ".join(f"{p} * {p}" for p in parts)


def r6(e: str) -> str:
    return f"(round({e}, 6) + 0e0)"


BASE = f"""WITH RECURSIVE atoms AS MATERIALIZED ({fixture.full_sql()}),
o AS MATERIALIZED (SELECT trajectory_id AS t, snapshot AS s, CAST(row_number() OVER (PARTITION BY trajectory_id, snapshot ORDER BY ord) - 1 AS INT) AS o, atom_id AS id, x, y, z FROM atoms WHERE atom_type = 2),
h AS MATERIALIZED (SELECT trajectory_id AS t, snapshot AS s, CAST(row_number() OVER (PARTITION BY trajectory_id, snapshot ORDER BY ord) - 1 AS INT) AS h, atom_id AS id, x, y, z FROM atoms WHERE atom_type = 1),
nn AS MATERIALIZED (SELECT t, s, h, hid, o, oid, sqrt(d2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY t, s, h ORDER BY d2, o) AS r FROM (SELECT h.t, h.s, h.h, h.id AS hid, o.o, o.id AS oid, {d2('h', 'o')} AS d2 FROM h JOIN o ON h.t = o.t AND h.s = o.s)) WHERE r = 1),
mol AS MATERIALIZED (SELECT o.t, o.s, o.o, o.id, CAST(count(nn.h) AS INT) AS n_h, list(nn.h ORDER BY nn.h) FILTER (WHERE nn.h IS NOT NULL) AS hs FROM o LEFT JOIN nn ON nn.t = o.t AND nn.s = o.s AND nn.o = o.o GROUP BY ALL),
ion AS MATERIALIZED (SELECT t, s, max(CASE WHEN n_h = 1 THEN o END) AS oh, max(CASE WHEN n_h = 3 THEN o END) AS h3o FROM mol GROUP BY t, s),
rec AS MATERIALIZED (SELECT t, coalesce(min(CASE WHEN ok THEN s END), count(*)) AS rt, count(CASE WHEN ok THEN 1 END) > 0 AS did FROM (SELECT t, s, bool_and(n_h = 2) AS ok FROM mol GROUP BY t, s) GROUP BY t),
com AS MATERIALIZED (SELECT o.t, o.s, o.o, {', '.join(f"CASE WHEN count(h.h) BETWEEN 1 AND 3 THEN ({MASS_O}e0 * any_value(o.{k}) + {MASS_H}e0 * sum(h.{k})) / ({MASS_O}e0 + {MASS_H}e0 * count(h.h)) END AS {k}" for k in 'xyz')}
  FROM o LEFT JOIN nn ON nn.t = o.t AND nn.s = o.s AND nn.o = o.o LEFT JOIN h ON h.t = nn.t AND h.s = nn.s AND h.h = nn.h GROUP BY o.t, o.s, o.o),
track AS MATERIALIZED (SELECT i.t, i.s, o.id, o.x, o.y, o.z FROM ion i JOIN rec ON rec.t = i.t AND i.s < rec.rt LEFT JOIN o ON o.t = i.t AND o.s = i.s AND o.o = i.h3o)"""

NET = f""",
oo AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, s, u ORDER BY d2, v) AS r FROM (SELECT a.t, a.s, a.o AS u, b.o AS v, {d2('a', 'b')} AS d2 FROM o a JOIN o b ON a.t = b.t AND a.s = b.s AND a.o <> b.o)) WHERE r <= 19 AND sqrt(d2) <= {CUTOFF}e0),
bh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, s, u, v ORDER BY hd, h) AS hr FROM (SELECT oo.t, oo.s, oo.u, oo.v, h.h, nn.rank AS slot, {d2('h', 'b')} AS hd FROM oo JOIN (SELECT *, row_number() OVER (PARTITION BY t, s, o ORDER BY h) - 1 AS rank FROM nn) nn ON nn.t = oo.t AND nn.s = oo.s AND nn.o = oo.u JOIN h ON h.t = oo.t AND h.s = oo.s AND h.h = nn.h JOIN o b ON b.t = oo.t AND b.s = oo.s AND b.o = oo.v)) WHERE hr = 1)"""


def _half(a: str, b: str, k: str) -> str:
    d = f"(({a}.{k} - {b}.{k}) * {L})"
    return f"(CASE WHEN {d} > {L} / 2e0 THEN {d} - {L} WHEN {d} < -{L} / 2e0 THEN {d} + {L} ELSE {d} END)"


def _edges(which: str, sign: str) -> str:
    don, acc = [_half("a", "h", k) for k in "xyz"], [f"({sign}{_half('b', 'h', k)})" for k in "xyz"]
    dot = " + ".join(f"{p} * {q}" for p, q in zip(don, acc))
    n = lambda v: "sqrt(" + " + ".join(f"{p} * {p}" for p in v) + ")"
    return f"SELECT t, s, u, v FROM (SELECT bh.t, bh.s, bh.u, bh.v, round(({dot}) / nullif({n(don)} * {n(acc)}, 0e0), 5) AS c FROM bh JOIN h ON h.t = bh.t AND h.s = bh.s AND h.h = bh.{which} JOIN o a ON a.t = bh.t AND a.s = bh.s AND a.o = bh.u JOIN o b ON b.t = bh.t AND b.s = bh.s AND b.o = bh.v) WHERE degrees(acos(c)) >= 150e0"


EDGE = NET + f",\ne AS MATERIALIZED ({_edges('h', '')})"
REACH = EDGE + """,
root AS MATERIALIZED (SELECT t, s, 'oh' AS k, oh AS o FROM ion WHERE oh IS NOT NULL UNION ALL SELECT t, s, 'h3o', h3o FROM ion WHERE h3o IS NOT NULL),
reach AS (SELECT t, s, k, o FROM root UNION SELECT r.t, r.s, r.k, e.v FROM reach r JOIN e ON e.t = r.t AND e.s = r.s AND e.u = r.o),
net AS MATERIALIZED (SELECT e.t, e.s, r.k, e.u, e.v FROM e JOIN reach r ON r.t = e.t AND r.s = e.s AND r.o = e.u)"""
WIRE = EDGE + """,
fr AS MATERIALIZED (SELECT i.t, i.s, i.oh, i.h3o FROM ion i JOIN rec ON rec.t = i.t AND i.s < rec.rt),
back AS (SELECT t, s, oh AS o, 0 AS d FROM fr WHERE oh IS NOT NULL UNION SELECT b.t, b.s, e.u, b.d + 1 FROM back b JOIN e ON e.t = b.t AND e.s = b.s AND e.v = b.o WHERE b.d < 27),
far AS MATERIALIZED (SELECT t, s, o, min(d) AS d FROM back GROUP BY ALL),
walk AS (SELECT fr.t, fr.s, fr.h3o AS o, far.d, [fr.h3o] AS path FROM fr JOIN far ON far.t = fr.t AND far.s = fr.s AND far.o = fr.h3o
  UNION ALL SELECT w.t, w.s, n.v, w.d - 1, list_append(w.path, n.v) FROM walk w, LATERAL (SELECT min(e.v) AS v FROM e JOIN far f ON f.t = e.t AND f.s = e.s AND f.o = e.v WHERE e.t = w.t AND e.s = w.s AND e.u = w.o AND f.d = w.d - 1) n WHERE w.d > 0),
wire AS MATERIALIZED (SELECT fr.t, fr.s, coalesce(len(w.path), 0) AS length, w.path FROM fr LEFT JOIN walk w ON w.t = fr.t AND w.s = fr.s AND w.d = 0),
isl AS MATERIALIZED (SELECT t, g, min(s) AS a, max(s) AS b, count(*) AS n, max(s) = any_value(last) AS open FROM (SELECT *, pos - row_number() OVER (PARTITION BY t ORDER BY s) AS g FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s) AS pos, max(s) OVER (PARTITION BY t) AS last FROM wire) WHERE length > 0) GROUP BY t, g)"""
TS = "t AS trajectory_id, s AS snapshot"


def sql(select: str, more: str = "", extra: str = "") -> str:
    return BASE + more + (",\n" + extra if extra else "") + "\n" + select


# ---------------------------------------------------------------- scans and geometry


@_query(sql(f"SELECT trajectory_id, snapshot, ord, atom_id, atom_type, {', '.join(f'{r6(k)} AS {k}' for k in 'xyz')} FROM atoms"))
def atoms_scan(spark, sf):
    return trajectory(spark, sf).atoms.select("trajectory_id", "snapshot", "ord", "atom_id", "atom_type", *(_r(k) for k in "xyz"))


@_query(sql(f"SELECT {TS}, 2 AS atom_type, o AS idx, id AS atom_id FROM o UNION ALL SELECT t, s, 1, h, id FROM h"))
def species_split(spark, sf):
    t = trajectory(spark, sf)
    one = lambda df, k: df.select(*FRAME, F.lit(k).alias("atom_type"), "idx", F.col("id").alias("atom_id"))
    return one(t.o, 2).unionByName(one(t.h, 1))


@_query(sql(f"SELECT DISTINCT trajectory_id, snapshot, {L} AS lx, {L} AS ly, {L} AS lz FROM atoms"))
def box_size(spark, sf):
    return trajectory(spark, sf).box_size()


@_query(sql(f"SELECT trajectory_id, snapshot, ord, {r6('CASE WHEN v >= 1e0 THEN v - 1e0 WHEN v < 0e0 THEN v + 1e0 ELSE v END')} AS w FROM (SELECT *, 2e0 * x - 0.5e0 AS v FROM atoms)"))
def wrapped_once(spark, sf):
    return trajectory(spark, sf).atoms.select("trajectory_id", "snapshot", "ord", _r(wrap_once(2.0 * F.col("x") - 0.5), "w"))


_NN = sql(f"SELECT {TS}, h AS h_idx, hid AS h_id, o AS o_idx, oid AS o_id, {r6('dist')} AS dist FROM nn")


@_query(_NN)
def nearest_neighbour(spark, sf):
    return trajectory(spark, sf).nearest_neighbour().withColumn("dist", _r("dist"))


@_query(_NN)
def nearest_neighbour_cells(spark, sf):
    return trajectory(spark, sf).nearest_neighbour(cell=3.0).withColumn("dist", _r("dist"))


@_query(sql(f"SELECT {TS}, h AS h_idx, hid AS h_id, o AS o_idx, oid AS o_id, {r6('sqrt(d2)')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY t, s, h ORDER BY d2, o) AS r FROM (SELECT h.t, h.s, h.h, h.id AS hid, o.o, o.id AS oid, {d2('h', 'o', fold=False)} AS d2 FROM h JOIN o ON h.t = o.t AND h.s = o.s)) WHERE r = 1"))
def nearest_neighbour_normal(spark, sf):
    return trajectory(spark, sf).nearest_neighbour("normal").withColumn("dist", _r("dist"))


@_query(sql(f"SELECT {TS}, u AS o_idx, v AS n_idx, CAST(r AS INT) AS rank, {r6('sqrt(d2)')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY t, s, u ORDER BY d2, v) AS r FROM (SELECT a.t, a.s, a.o AS u, b.o AS v, {d2('a', 'b')} AS d2 FROM o a JOIN o b ON a.t = b.t AND a.s = b.s AND a.o <> b.o)) WHERE r <= 19"))
def k_nearest_oxygens(spark, sf):
    return trajectory(spark, sf).k_nearest().withColumn("dist", _r("dist"))


@_query(sql(f"SELECT a.t AS trajectory_id, a.s AS snapshot, a.o AS a_idx, b.o AS b_idx, {r6('sqrt(' + d2('a', 'b') + ')')} AS dist FROM o a JOIN o b ON a.t = b.t AND a.s = b.s"))
def distance_matrix(spark, sf):
    return neighbours.all_distances(trajectory(spark, sf).o).withColumn("dist", _r("dist"))


@_query(sql(f"SELECT {TS}, bin, rr AS r, count(*) AS n FROM (SELECT a.t, a.s, sqrt({d2('a', 'b')}) AS d FROM o a JOIN o b ON a.t = b.t AND a.s = b.s) p, (VALUES (0, 2.5e0), (1, 3.25e0), (2, 4.5e0)) k(bin, rr) WHERE d > 0 AND d <= rr GROUP BY ALL"))
def ball_counts(spark, sf):
    o = trajectory(spark, sf).o
    return neighbours.ball_counts(o, o, [2.5, 3.25, 4.5])


# ---------------------------------------------------------------- molecules and ions


@_query(sql(f"SELECT {TS}, o AS o_idx, id AS o_id, n_h, coalesce(array_to_string(hs, ','), '') AS h_list FROM mol"))
def molecules(spark, sf):
    return trajectory(spark, sf).molecules.select(*FRAME, "o_idx", "o_id", "n_h", _join("h_list"))


@_query(sql(f"SELECT {TS}, oh, h3o FROM ion"))
def ion_detect(spark, sf):
    return trajectory(spark, sf).ions


@_query(sql("SELECT t AS trajectory_id, rt AS recombination_time, did AS did_recombine FROM rec"))
def recombination_time(spark, sf):
    return trajectory(spark, sf).recombination


@_query(sql(f"SELECT i.t AS trajectory_id, i.s AS snapshot, oh, h3o, {r6('sqrt(' + d2('a', 'b', scaled=True) + ')')} AS dist_scaled, {r6('sqrt(' + d2('a', 'b') + ')')} AS dist_ang, {r6('a.x')} AS oh_x, {r6('b.z')} AS h3o_z FROM ion i LEFT JOIN o a ON a.t = i.t AND a.s = i.s AND a.o = i.oh LEFT JOIN o b ON b.t = i.t AND b.s = i.s AND b.o = i.h3o"))
def ion_distance(spark, sf):
    return trajectory(spark, sf).ion_distance().select(*FRAME, "oh", "h3o", _r("dist_scaled"), _r("dist_ang"), _r("oh_x"), _r("h3o_z"))


@_query(sql(f"SELECT {TS}, n_h, count(*) AS n, {r6('count(*) / 27e0')} AS density FROM mol GROUP BY t, s, n_h"))
def water_hist(spark, sf):
    return trajectory(spark, sf).water_histogram().withColumn("density", _r("density"))


# ---------------------------------------------------------------- radial distribution

_STEP = f"(({STOP}e0 - 0.01e0) / 49e0)"
_SHELL = f"(4e0 * pi() * pow(0.01e0 + (b + 1) * {_STEP}, 3e0) / 3e0 - 4e0 * pi() * pow(0.01e0 + b * {_STEP}, 3e0) / 3e0)"


def _rdf_sql(pairs: str, n_ref: str, n_b: int, frames: str, tail: str, name: str) -> str:
    extra = f"""pr AS (SELECT t, s, CAST(least(floor((d - 0.01e0) / {_STEP}), 48) AS INT) AS b, count(*) AS n FROM ({pairs}) WHERE d >= 0.01e0 AND d <= {STOP}e0 GROUP BY ALL),
fb AS ({frames}), g AS MATERIALIZED (SELECT fb.t, fb.s, CAST(fb.b AS INT) AS b, 0.01e0 + (fb.b + 1) * {_STEP} AS r, coalesce(pr.n, 0) / {n_ref} / {_SHELL.replace('(b', '(fb.b').replace('+ b', '+ fb.b')} / ({n_b}e0 / ({L} * {L} * {L})) AS g FROM fb LEFT JOIN pr ON pr.t = fb.t AND pr.s = fb.s AND pr.b = fb.b)"""
    return sql(tail.format(name=name), "", extra)


_ALL = "SELECT t, s, unnest(range(0, 49)) AS b FROM (SELECT DISTINCT t, s FROM o)"
_MEAN = f"SELECT t AS trajectory_id, '{{name}}' AS gr_type, b AS bin, {r6('avg(r)')} AS r, {r6('avg(g)')} AS g FROM g GROUP BY t, b"


def _pairs(a: str, b: str) -> str:
    return f"SELECT a.t, a.s, sqrt({d2('a', 'b')}) AS d FROM {a} a JOIN {b} b ON a.t = b.t AND a.s = b.s"


def _ion_rdf(kind: str, name: str) -> str:
    first = f"fi AS MATERIALIZED (SELECT m.t, m.s, min(m.o) AS o FROM mol m JOIN rec ON rec.t = m.t AND m.s < rec.rt WHERE n_h = {1 if kind == 'oh' else 3} GROUP BY ALL)"
    pairs = f"SELECT a.t, a.s, sqrt({d2('a', 'b')}) AS d FROM fi JOIN o a ON a.t = fi.t AND a.s = fi.s AND a.o = fi.o JOIN o b ON a.t = b.t AND a.s = b.s"
    body = _rdf_sql(pairs, "1e0", 27, "SELECT t, s, unnest(range(0, 49)) AS b FROM fi", _MEAN, name)
    return body.replace(",\npr AS", f",\n{first},\npr AS", 1)


def _rdf_query(name: str, gr: str, text: str):
    def f(spark, sf):
        return trajectory(spark, sf).rdf(gr, stop=STOP).select("trajectory_id", "gr_type", "bin", _r("r"), _r("g"))

    f.__name__ = name
    _query(text, name)(f)


_rdf_query("rdf_oo", "OO", _rdf_sql(_pairs("o", "o"), "27e0", 27, _ALL, _MEAN, "OO"))
_rdf_query("rdf_hh", "HH", _rdf_sql(_pairs("h", "h"), "54e0", 54, _ALL, _MEAN, "HH"))
_rdf_query("rdf_oh", "OH", _rdf_sql(_pairs("o", "h"), "27e0", 54, _ALL, _MEAN, "OH"))
_rdf_query("rdf_oh_ion", "OH_ion", _ion_rdf("oh", "OH_ion"))
_rdf_query("rdf_h3o_ion", "H3O_ion", _ion_rdf("h3o", "H3O_ion"))


@_query(_rdf_sql(_pairs("o", "o"), "27e0", 27, _ALL, f"SELECT {TS}, 'OO' AS gr_type, b AS bin, {r6('r')} AS r, {r6('g')} AS g FROM g WHERE s = 3", "OO"))
def rdf_single(spark, sf):
    return trajectory(spark, sf).rdf("OO", stop=STOP, snapshot=3).withColumns({"r": _r("r"), "g": _r("g")})


@_query(_rdf_sql(_pairs("o", "o"), "27e0", 27, _ALL, f"SELECT trajectory_id, gr_type, bin, {r6('c')} AS cumulative, {r6('c - coalesce(lag(c) OVER (PARTITION BY trajectory_id ORDER BY bin), 0e0)')} AS difference FROM (SELECT t AS trajectory_id, 'OO' AS gr_type, b AS bin, sum(avg(g)) OVER (PARTITION BY t ORDER BY b) AS c FROM g GROUP BY t, b)", "OO"))
def rdf_cumulative(spark, sf):
    c = rdf.cumulative(trajectory(spark, sf).rdf("OO", stop=STOP))
    return c.select("trajectory_id", "gr_type", "bin", _r("cumulative"), _r("difference"))


@_query(_rdf_sql(_pairs("o", "o"), "27e0", 27, _ALL, f"SELECT 'OO' AS gr_type, b AS bin, {r6('avg(r)')} AS r, {r6('avg(g)')} AS g FROM (SELECT g.t, b, avg(r) AS r, avg(g) AS g FROM g JOIN rec ON rec.t = g.t AND rec.did GROUP BY g.t, b) GROUP BY b", "OO"))
def rdf_averaged(spark, sf):
    return trajectory(spark, sf).averaged_rdf(("OO",), stop=STOP).select("gr_type", "bin", _r("r"), _r("g"))


# ---------------------------------------------------------------- dynamics

_MSD = f"msd AS MATERIALIZED (SELECT c.t, c.s, sum({d2('c', 'z', scaled=True, fold=False)}) / any_value(n.n) AS m FROM com c JOIN com z ON z.t = c.t AND z.s = 0 AND z.o = c.o AND z.x IS NOT NULL JOIN (SELECT t, count(*) AS n FROM com WHERE s = 0 AND x IS NOT NULL GROUP BY t) n ON n.t = c.t WHERE c.x IS NOT NULL GROUP BY c.t, c.s)"


@_query(sql(f"SELECT {TS}, {r6('m')} AS msd FROM msd", "", _MSD))
def msd(spark, sf):
    return trajectory(spark, sf).msd().withColumn("msd", _r("msd"))


@_query(sql(f"SELECT q.t AS trajectory_id, {r6('avg(CASE WHEN abs(q - m) < 0.1e0 * m THEN q END) / 6e0')} AS diffusion FROM q JOIN (SELECT t, median(q) AS m FROM q GROUP BY t) k ON k.t = q.t GROUP BY q.t", "", _MSD + ",\nq AS MATERIALIZED (SELECT * FROM (SELECT t, s, (lead(m) OVER (PARTITION BY t ORDER BY s) - m) / 0.0005e0 AS q FROM msd) WHERE q IS NOT NULL)"))
def translational_diffusion(spark, sf):
    return trajectory(spark, sf).translational_diffusion().withColumn("diffusion", _r("diffusion"))


def _circ(k: str) -> str:
    tau = repr(2 * math.pi) + "e0"
    total = repr(2 * MASS_H + MASS_O) + "e0"
    xi = " + ".join(f"{m}e0 * cos({tau} * {a}.{k})" for m, a in ((MASS_H, "a"), (MASS_H, "b"), (MASS_O, "c")))
    ze = " + ".join(f"{m}e0 * sin({tau} * {a}.{k})" for m, a in ((MASS_H, "a"), (MASS_H, "b"), (MASS_O, "c")))
    return f"(atan2(-(({ze}) / {total}), -(({xi}) / {total})) + pi()) / {tau}"


_ROT = f"""pick AS MATERIALIZED (SELECT t, o, any_value(oid) AS oid, max(CASE WHEN k = 1 THEN hid END) AS h1, max(CASE WHEN k = 2 THEN hid END) AS h2 FROM (SELECT *, row_number() OVER (PARTITION BY t, o ORDER BY h) AS k FROM nn WHERE s = 0) WHERE k <= 2 GROUP BY t, o HAVING count(*) = 2),
wm AS MATERIALIZED (SELECT c.t, c.s, p.o, {', '.join(f'a.{k} AS a_{k}, b.{k} AS b_{k}, {_circ(k)} AS m_{k}' for k in 'xyz')} FROM pick p JOIN o c ON c.t = p.t AND c.id = p.oid JOIN h a ON a.t = c.t AND a.s = c.s AND a.id = p.h1 JOIN h b ON b.t = c.t AND b.s = c.s AND b.id = p.h2),
sh AS (SELECT t, s, o, {', '.join(f'CASE WHEN {v}_{k} + (0.5e0 - a_{k}) > 1e0 THEN {v}_{k} + (0.5e0 - a_{k}) - 1e0 WHEN {v}_{k} + (0.5e0 - a_{k}) < 0e0 THEN {v}_{k} + (0.5e0 - a_{k}) + 1e0 ELSE {v}_{k} + (0.5e0 - a_{k}) END AS {v}_{k}' for v in 'abm' for k in 'xyz')} FROM wm),
pv AS (SELECT t, s, o, {', '.join(f'(a_{k} + b_{k}) / 2e0 - m_{k} AS p{k}' for k in 'xyz')} FROM sh),
pn AS (SELECT t, s, o, {', '.join(f'p{k} / sqrt(px * px + py * py + pz * pz) AS p{k}' for k in 'xyz')} FROM pv),
lg AS (SELECT *, {', '.join(f'lag(p{k}) OVER (PARTITION BY t, o ORDER BY s) AS q{k}' for k in 'xyz')} FROM pn),
cr AS (SELECT t, s, o, qx, qx * px + qy * py + qz * pz AS c, qy * pz - qz * py AS vx, qz * px - qx * pz AS vy, qx * py - qy * px AS vz FROM lg),
dl AS (SELECT t, s, o, {', '.join(f'CASE WHEN qx IS NULL OR sqrt(vx * vx + vy * vy + vz * vz) = 0 THEN 0e0 ELSE acos(greatest(least(c, 1e0), -1e0)) * v{k} / sqrt(vx * vx + vy * vy + vz * vz) END AS d{k}' for k in 'xyz')} FROM cr),
ph AS (SELECT t, s, o, {', '.join(f'coalesce(0.0005e0 * (sum(d{k}) OVER (PARTITION BY t, o ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - lag(d{k}) OVER (PARTITION BY t, o ORDER BY s) / 2e0), 0e0) AS f{k}' for k in 'xyz')} FROM dl)"""


@_query(sql(f"SELECT {TS}, {r6('avg(fx * fx + fy * fy + fz * fz) * 1e6')} AS rmsd_millionths FROM ph GROUP BY t, s", "", _ROT))
def rotational_msd(spark, sf):
    return trajectory(spark, sf).rotational_diffusion().select(*FRAME, _r(F.col("rmsd") * 1e6, "rmsd_millionths"))


@_query(sql(f"SELECT c.t AS trajectory_id, c.s AS snapshot, c.o AS o_idx, {', '.join(f'{r6(_circ(k))} AS c{k}' for k in 'xyz')} FROM mol m JOIN o c ON c.t = m.t AND c.s = m.s AND c.o = m.o JOIN h a ON a.t = m.t AND a.s = m.s AND a.h = m.hs[1] JOIN h b ON b.t = m.t AND b.s = m.s AND b.h = m.hs[2] WHERE m.n_h = 2"))
def com_circular(spark, sf):
    t = trajectory(spark, sf)
    m = t.molecules.where("n_h = 2").select(*FRAME, F.col("o_idx").alias("idx"), F.col("h_list")[0].alias("h1"), F.col("h_list")[1].alias("h2"))
    side = lambda df, key, p: df.select(*FRAME, F.col("idx").alias(key), *(F.col(k).alias(f"{p}{k}") for k in "xyz"))
    j = m.join(side(t.o, "idx", "o"), [*FRAME, "idx"]).join(side(t.h, "h1", "a"), [*FRAME, "h1"]).join(side(t.h, "h2", "b"), [*FRAME, "h2"])
    return j.select(*FRAME, F.col("idx").alias("o_idx"), *(_r(e, f"c{k}") for k, e in zip("xyz", water_com(axes("a"), axes("b"), axes("o")))))


def _speed(kind: str) -> str:
    steps = " + ".join(f"{img(f'c.{k} - lag(c.{k}) OVER (PARTITION BY i.t ORDER BY i.s)', '1e0')} * {img(f'c.{k} - lag(c.{k}) OVER (PARTITION BY i.t ORDER BY i.s)', '1e0')}" for k in "xyz")
    return f"SELECT i.t, i.s, sqrt({steps}) / 0.0005e0 AS v FROM ion i JOIN rec ON rec.t = i.t AND i.s < rec.rt LEFT JOIN com c ON c.t = i.t AND c.s = i.s AND c.o = i.{kind}"


@_query(sql(f"SELECT a.t AS trajectory_id, a.s AS snapshot, {r6('a.v')} AS oh_speed, {r6('b.v')} AS h3o_speed FROM ({_speed('oh')}) a JOIN ({_speed('h3o')}) b ON a.t = b.t AND a.s = b.s WHERE a.s >= 1"))
def ion_speed(spark, sf):
    return trajectory(spark, sf).ion_speed().select(*FRAME, _r("oh_speed"), _r("h3o_speed"))


_JUMP = "jp AS MATERIALIZED (SELECT t, s, id, jump FROM (SELECT t, s, id, id <> lead(id) OVER w AS jump, lead(s) OVER w AS nx FROM track WINDOW w AS (PARTITION BY t ORDER BY s)) WHERE nx IS NOT NULL)"


@_query(sql(f"SELECT {TS}, id AS ion_id, jump AS is_jump FROM jp", "", _JUMP))
def jump_trace(spark, sf):
    return trajectory(spark, sf).jump_trace()


_DIFF = _JUMP + f""",
dr AS (SELECT jp.t, jp.s, x, y, z, jp.s - row_number() OVER (PARTITION BY jp.t ORDER BY jp.s) AS g FROM jp JOIN track k ON k.t = jp.t AND k.s = jp.s WHERE NOT jump),
ds AS (SELECT *, {', '.join(f'x{i} * 0 + {img(f"{k} - lag({k}) OVER (PARTITION BY t, g ORDER BY s)", "1e0")} AS d{k}'.replace(f'x{i} * 0 + ', '') for i, k in enumerate('xyz'))} FROM dr)"""


@_query(sql(f"SELECT t AS trajectory_id, min(s) AS start, count(*) AS frames, {r6('coalesce(sum(sqrt(dx * dx + dy * dy + dz * dz)), 0e0)')} AS distance FROM ds GROUP BY t, g HAVING count(*) >= 2", "", _DIFF))
def diffusion_distance(spark, sf):
    return trajectory(spark, sf).diffusion_distance().withColumn("distance", _r("distance"))


@_query(sql(f"SELECT jp.t AS trajectory_id, jp.s AS snapshot, {r6('sqrt(' + d2('a', 'b', scaled=True) + ')')} AS distance FROM jp JOIN track a ON a.t = jp.t AND a.s = jp.s JOIN track b ON b.t = jp.t AND b.s = jp.s + 1 WHERE jump", "", _JUMP))
def jump_distance(spark, sf):
    return trajectory(spark, sf).jump_distance().withColumn("distance", _r("distance"))


_CHUNK = _JUMP + """,
jj AS (SELECT t, s AS b, coalesce(lag(s) OVER (PARTITION BY t ORDER BY s) + 1, 0) AS a FROM jp WHERE jump),
ch AS MATERIALIZED (SELECT t, a, b FROM jj UNION ALL SELECT k.t, coalesce(e + 1, 0), last FROM (SELECT t, max(s) AS last FROM track GROUP BY t) k LEFT JOIN (SELECT t, max(b) AS e FROM jj GROUP BY t) m ON m.t = k.t WHERE e IS NULL OR e < last)"""


@_query(sql('SELECT t AS trajectory_id, a AS start, b AS "end" FROM ch', "", _CHUNK))
def diffusion_chunks(spark, sf):
    return dynamics.diffusion_chunks(trajectory(spark, sf).ion_track())


def _lag_sql(source: str, key: str = "t", p: str = "p") -> str:
    return f"SELECT a.{key}, b.p - a.p AS lag, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS m FROM ({source}) a JOIN ({source}) b ON a.{key} = b.{key} AND b.p > a.p GROUP BY ALL"


_PATH = f"path AS MATERIALIZED (SELECT t, s, row_number() OVER (PARTITION BY t ORDER BY s) - 1 AS p, x * {L} AS x, y * {L} AS y, z * {L} AS z FROM track WHERE id IS NOT NULL)"


@_query(sql(f"SELECT t AS trajectory_id, lag, {r6('m')} AS msd FROM ({_lag_sql('SELECT * FROM path')})", "", _PATH))
def msd_lag(spark, sf):
    return dynamics.lag_msd(dynamics.path_ang(trajectory(spark, sf).ion_track()).drop("snapshot")).withColumn("msd", _r("msd"))


@_query(sql(f"SELECT t AS trajectory_id, lag, {r6('avg(m)')} AS msd FROM (SELECT t, st, b.p - a.p AS lag, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS m FROM ic a JOIN ic b USING (t, st) WHERE b.p > a.p GROUP BY ALL) GROUP BY t, lag", "", _CHUNK + ",\n" + _PATH + ",\nic AS MATERIALIZED (SELECT path.t, ch.a AS st, path.s AS p, x, y, z FROM path JOIN ch ON ch.t = path.t AND path.s BETWEEN ch.a AND ch.b)"))
def msd_chunked(spark, sf):
    return dynamics.chunked_msd(trajectory(spark, sf).ion_track()).withColumn("msd", _r("msd"))


_STITCH = _JUMP + ",\n" + _PATH + f""",
kp AS (SELECT path.t, path.s, x, y, z FROM path LEFT JOIN jp ON jp.t = path.t AND jp.s = path.s WHERE NOT coalesce(jump, false)),
st AS (SELECT t, s, {', '.join(f'CASE WHEN s - lag(s) OVER w = 1 THEN {k} - lag({k}) OVER w ELSE 0e0 END AS d{k}, first({k}) OVER w AS f{k}' for k in 'xyz')} FROM kp WINDOW w AS (PARTITION BY t ORDER BY s)),
sd AS MATERIALIZED (SELECT t, row_number() OVER (PARTITION BY t ORDER BY s) - 1 AS p, {', '.join(f'fx0_{k} + sum(d{k}) OVER (PARTITION BY t ORDER BY s ROWS UNBOUNDED PRECEDING) AS {k}'.replace(f'fx0_{k}', f'f{k}') for k in 'xyz')} FROM st),
hp AS (SELECT a.t, a.s, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM path a JOIN jp ON jp.t = a.t AND jp.s = a.s AND jump JOIN path b ON b.t = a.t AND b.p = a.p + 1),
sj AS MATERIALIZED (SELECT DISTINCT t, 0 AS p, 0e0 AS x, 0e0 AS y, 0e0 AS z FROM track UNION ALL SELECT t, row_number() OVER w, {', '.join(f'sum({k}) OVER (w ROWS UNBOUNDED PRECEDING)' for k in 'xyz')} FROM hp WINDOW w AS (PARTITION BY t ORDER BY s))"""


@_query(sql(f"SELECT t AS trajectory_id, lag, {r6('m')} AS msd FROM ({_lag_sql('SELECT * FROM sd')})", "", _STITCH))
def msd_stitched_diffusion(spark, sf):
    return dynamics.lag_msd(dynamics.stitched(trajectory(spark, sf).ion_track())[0]).withColumn("msd", _r("msd"))


@_query(sql(f"SELECT t AS trajectory_id, lag, {r6('m')} AS msd FROM ({_lag_sql('SELECT * FROM sj')})", "", _STITCH))
def msd_stitched_jump(spark, sf):
    return dynamics.lag_msd(dynamics.stitched(trajectory(spark, sf).ion_track())[1]).withColumn("msd", _r("msd"))


_DIST = f"dist AS MATERIALIZED (SELECT i.t, i.s, row_number() OVER (PARTITION BY i.t ORDER BY i.s) AS i, v - avg(v) OVER (PARTITION BY i.t) AS v FROM (SELECT i.t, i.s, sqrt({d2('a', 'b', scaled=True)}) AS v FROM ion i JOIN rec ON rec.t = i.t AND i.s < rec.rt JOIN o a ON a.t = i.t AND a.s = i.s AND a.o = i.oh JOIN o b ON b.t = i.t AND b.s = i.s AND b.o = i.h3o) i)"


@_query(sql(f"SELECT k.t AS trajectory_id, lag, {r6('c / nullif(c0, 0e0)')} AS acf FROM (SELECT a.t, b.i - a.i AS lag, avg(a.v * b.v) AS c FROM dist a JOIN dist b ON a.t = b.t AND b.i >= a.i GROUP BY ALL) k JOIN (SELECT t, avg(v * v) AS c0 FROM dist GROUP BY t) z ON z.t = k.t", "", _DIST))
def acf(spark, sf):
    t = trajectory(spark, sf)
    return stats.acf(t.before(t.ion_distance()), "dist_scaled").withColumn("acf", _r("acf"))


@_query(sql(f"SELECT t AS trajectory_id, lag, {r6('sum(v * u) / nullif(any_value(scale), 0e0)')} AS correlation FROM (SELECT a.t, a.v, b.u, a.i - b.i - ((n + m - 1) // 2 - (m - 1)) AS lag, sqrt(vv * uu) AS scale FROM dist a JOIN hx b ON a.t = b.t JOIN (SELECT t, count(*) AS n, sum(v * v) AS vv FROM dist GROUP BY t) p ON p.t = a.t JOIN (SELECT t, count(*) AS m, sum(u * u) AS uu FROM hx GROUP BY t) q ON q.t = a.t) WHERE lag >= 0 GROUP BY t, lag", "", _DIST + ",\nhx AS MATERIALIZED (SELECT t, row_number() OVER (PARTITION BY t ORDER BY s) AS i, x - avg(x) OVER (PARTITION BY t) AS u FROM track WHERE id IS NOT NULL AND s > 0)"))
def cross_acf(spark, sf):
    t = trajectory(spark, sf)
    x = t.before(t.ion_distance()).select(*FRAME, F.col("dist_scaled").alias("value"))
    y = t.ion_track().where("ion_id IS NOT NULL AND snapshot > 0").select(*FRAME, F.col("x").alias("value"))
    return stats.cross_correlation(x, y).withColumn("correlation", _r("correlation"))


@_query(sql(f"SELECT trajectory_id, snapshot, atom_id, {r6('x - sum(st) OVER (PARTITION BY trajectory_id, atom_id ORDER BY snapshot)')} AS x FROM (SELECT *, coalesce(round_even(x - lag(x) OVER (PARTITION BY trajectory_id, atom_id ORDER BY snapshot), 0), 0e0) AS st FROM atoms)"))
def unwrap_pbc(spark, sf):
    return dynamics.unwrap(trajectory(spark, sf).atoms).select(*FRAME, "atom_id", _r("x"))


# ---------------------------------------------------------------- hydrogen bonds


@_query(sql(f"SELECT {TS}, u AS src_o, v AS dst_o FROM e", EDGE))
def hbond_edges(spark, sf):
    return trajectory(spark, sf).hbond_edges(CUTOFF)


@_query(sql(f"SELECT {TS}, u AS src_o, v AS dst_o FROM ({_edges('slot', '-')})", NET))
def hbond_edges_as_written(spark, sf):
    return trajectory(spark, sf, "as_written").hbond_edges(CUTOFF)


def _net_query(root: str):
    def f(spark, sf):
        return trajectory(spark, sf).hbond_network(root, CUTOFF)

    _query(sql(f"SELECT {TS}, k AS root_kind, u AS src_o, v AS dst_o FROM net WHERE k = '{root}'", REACH), f"hbond_network_{root}")(f)


_net_query("oh")
_net_query("h3o")


@_query(sql("SELECT net.t AS trajectory_id, s AS snapshot, k AS root_kind, u AS src_o, v AS dst_o FROM net JOIN rec ON rec.t = net.t AND s < rt", REACH))
def hb_timeseries(spark, sf):
    return trajectory(spark, sf).hb_timeseries(CUTOFF)


_RATIO = REACH + """,
ratio AS MATERIALIZED (SELECT f.t, f.s, count(CASE WHEN k = 'oh' THEN 1 END) / 27e0 AS a, count(CASE WHEN k = 'h3o' THEN 1 END) / 27e0 AS b, count(k) / 27e0 AS c FROM (SELECT i.t, i.s FROM ion i JOIN rec ON rec.t = i.t AND i.s < rt) f LEFT JOIN net ON net.t = f.t AND net.s = f.s GROUP BY f.t, f.s)"""


@_query(sql(f"SELECT {TS}, {r6('a')} AS oh_ratio, {r6('b')} AS h3o_ratio, {r6('c')} AS total_ratio FROM ratio", _RATIO))
def hb_ratio(spark, sf):
    return trajectory(spark, sf).hb_ratio(CUTOFF).select(*FRAME, _r("oh_ratio"), _r("h3o_ratio"), _r("total_ratio"))


@_query(sql(f"SELECT {TS}, {r6('coalesce((hm + lag(hm) OVER (PARTITION BY t ORDER BY s)) / 2e0, 0e0)')} AS hma FROM (SELECT t, s, 2e0 * (c * 2 + lag(c) OVER w) / 3e0 - (c * 5 + lag(c, 1) OVER w * 4 + lag(c, 2) OVER w * 3 + lag(c, 3) OVER w * 2 + lag(c, 4) OVER w) / 15e0 AS hm FROM ratio WINDOW w AS (PARTITION BY t ORDER BY s))", _RATIO))
def hb_ratio_hma(spark, sf):
    return stats.hull(trajectory(spark, sf).hb_ratio(CUTOFF), "total_ratio", 5).select(*FRAME, _r("hma"))


@_query(sql(f"SELECT DISTINCT {TS}, least(u, v) AS a_o, greatest(u, v) AS b_o FROM net WHERE k = 'h3o'", REACH))
def mirror_dedup(spark, sf):
    return hbonds.mirror_free(trajectory(spark, sf).hbond_network("h3o", CUTOFF))


@_query(sql(f"SELECT {TS}, CAST(length AS INT) AS length, array_to_string(path, ',') AS path FROM wire", WIRE))
def wires(spark, sf):
    return trajectory(spark, sf).wires(CUTOFF).select(*FRAME, "length", _join("path"))


@_query(sql("SELECT w.t AS trajectory_id, w.s AS snapshot, CAST(w.length AS INT) AS length, array_to_string(w.path, ',') AS path FROM wire w JOIN (SELECT t, max(b) AS b, arg_max(a, b) AS a FROM isl GROUP BY t) i ON i.t = w.t AND w.s BETWEEN i.a AND i.b", WIRE))
def last_wire(spark, sf):
    return trajectory(spark, sf).last_wire(CUTOFF).select(*FRAME, "length", _join("path"))


@_query(sql("SELECT t AS trajectory_id, a AS start, n AS lifetime FROM isl WHERE NOT open", WIRE))
def wire_lifetime(spark, sf):
    return trajectory(spark, sf).wire_lifetimes(CUTOFF)


@_query(sql(f"SELECT p.t AS trajectory_id, p.s AS snapshot, CAST(any_value(p.length) AS INT) AS length, {r6('sum(sqrt(' + d2('a', 'b') + ')) / (any_value(p.length) - 1)')} AS mean_distance FROM (SELECT t, s, length, path[i] AS u, path[i + 1] AS v FROM (SELECT *, unnest(range(1, length)) AS i FROM wire WHERE length > 1)) p JOIN o a ON a.t = p.t AND a.s = p.s AND a.o = p.u JOIN o b ON b.t = p.t AND b.s = p.s AND b.o = p.v GROUP BY p.t, p.s", WIRE))
def wire_distance(spark, sf):
    return trajectory(spark, sf).wire_distances(CUTOFF).withColumn("mean_distance", _r("mean_distance"))


@_query(sql(f"SELECT l.t AS trajectory_id, CAST(l.b AS INT) AS bin, {r6('l.lo + l.b * (l.hi - l.lo) / 10e0')} AS left_edge, count(w.t) AS n FROM (SELECT *, unnest(range(0, 10)) AS b FROM (SELECT t, CASE WHEN min(length) = max(length) THEN min(length) - 0.5e0 ELSE min(length) END AS lo, CASE WHEN min(length) = max(length) THEN max(length) + 0.5e0 ELSE max(length) END AS hi FROM wire GROUP BY t)) l LEFT JOIN wire w ON w.t = l.t AND least(floor((w.length - l.lo) / ((l.hi - l.lo) / 10e0)), 9) = l.b GROUP BY l.t, l.b, l.lo, l.hi", WIRE))
def wire_length_hist(spark, sf):
    return hbonds.length_histogram(trajectory(spark, sf).wires(CUTOFF)).withColumn("left_edge", _r("left_edge"))


@_query(sql("""SELECT q.t AS trajectory_id, q.s AS snapshot, q.ion, q.o AS o_idx, m.n_h, coalesce(array_to_string(m.hs, ','), '') AS h_list FROM (
  SELECT DISTINCT n.t, n.s, f.h3o AS ion, unnest([n.u, n.v]) AS o FROM net n JOIN fr3 f ON f.t = n.t AND f.s = n.s WHERE n.k = 'h3o' AND (n.u = f.h3o OR n.v = f.h3o)
  UNION SELECT f.t, f.s, f.h3o, f.h3o FROM fr3 f WHERE NOT EXISTS (SELECT 1 FROM net n WHERE n.t = f.t AND n.s = f.s AND n.k = 'h3o')) q JOIN mol m ON m.t = q.t AND m.s = q.s AND m.o = q.o""", REACH, "fr3 AS MATERIALIZED (SELECT i.t, i.s, i.h3o FROM ion i JOIN rec ON rec.t = i.t AND i.s < rt WHERE h3o IS NOT NULL)"))
def transition_cations(spark, sf):
    return trajectory(spark, sf).transition_ions("h3o", CUTOFF).select(*FRAME, "ion", "o_idx", "n_h", _join("h_list"))


# ---------------------------------------------------------------- editing and export

_AM = "am AS MATERIALIZED (SELECT t, s, h AS i, 1 AS ty, hid AS id, o AS mol FROM nn UNION ALL SELECT t, s, o, 2, id, o FROM o)"


@_query(sql(f"SELECT t AS trajectory_id, s AS snapshot, CAST(row_number() OVER (PARTITION BY t ORDER BY copy, ty, ord) - 1 AS BIGINT) AS atom_id, CAST(ty AS INT) AS atom_type, {', '.join(f'{r6(f"({k} + d{k}) * {L}")} AS {k}' for k in 'xyz')} FROM (SELECT a.t, a.s, a.ty, b.ord, b.x, b.y, b.z, copy, CAST(copy // 4 AS DOUBLE) AS dx, CAST(copy // 2 % 2 AS DOUBLE) AS dy, CAST(copy % 2 AS DOUBLE) AS dz FROM am a JOIN mol m ON m.t = a.t AND m.s = a.s AND m.o = a.mol AND m.n_h = 2 JOIN atoms b ON b.trajectory_id = a.t AND b.snapshot = a.s AND b.atom_id = a.id, (SELECT unnest(range(0, 8)) AS copy) WHERE a.s = 0)", "", _AM))
def expand_system(spark, sf):
    return trajectory(spark, sf).expand(0).atoms.select(*FRAME, "atom_id", "atom_type", *(_r(k) for k in "xyz"))


@_query(sql("SELECT a.t AS trajectory_id, a.s AS snapshot, b.ord, a.id AS atom_id, CAST(ty AS INT) AS atom_type FROM am a JOIN mol m ON m.t = a.t AND m.s = a.s AND m.o = a.mol JOIN atoms b ON b.trajectory_id = a.t AND b.snapshot = a.s AND b.atom_id = a.id WHERE a.s = 2 AND NOT (m.id IN (9, 30) AND m.n_h > 0)", "", _AM))
def remove_molecules(spark, sf):
    return trajectory(spark, sf).remove_molecules(snapshot=2, o_ids=[9, 30]).atoms.select(*FRAME, "ord", "atom_id", "atom_type")


@_query(sql(f"SELECT trajectory_id, snapshot, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY atom_type, ord) AS BIGINT) AS id, atom_type, {', '.join(f'{r6(f"{k} * {L}")} AS {k}' for k in 'xyz')} FROM atoms WHERE snapshot = 1"))
def cut_snapshot_rows(spark, sf):
    t = trajectory(spark, sf).at(1)
    b = writers.data_lines(t.atoms, t.frames).where("seq > 0").withColumn("t", F.split("value", " "))
    return b.select(*FRAME, F.col("t")[0].cast("long").alias("id"), F.col("t")[1].cast("int").alias("atom_type"), *(_r(F.col("t")[2 + i].cast("double"), k) for i, k in enumerate("xyz")))


@_query(sql("SELECT a.t AS trajectory_id, a.s AS snapshot, CAST(row_number() OVER (PARTITION BY a.t, a.s ORDER BY a.mol, ty, b.ord) - 1 AS INT) AS ord, a.id AS atom_id, CAST(m.n_h + 1 AS INT) AS atom_type FROM am a JOIN mol m ON m.t = a.t AND m.s = a.s AND m.o = a.mol JOIN atoms b ON b.trajectory_id = a.t AND b.snapshot = a.s AND b.atom_id = a.id", "", _AM))
def group_molecules_rows(spark, sf):
    return trajectory(spark, sf).grouped().atoms.select(*FRAME, "ord", "atom_id", "atom_type")


_DSP = f"""pk AS MATERIALIZED (SELECT b.t, b.s, min(b.o) AS o FROM o a JOIN o b ON a.t = b.t AND a.s = b.s AND a.o <> b.o JOIN mol m ON m.t = b.t AND m.s = b.s AND m.o = b.o AND m.n_h >= 2 WHERE a.s = 4 AND a.o = 13 AND sqrt({d2('b', 'a', scaled=True, fold=False)}) BETWEEN 0.3e0 AND 0.4e0 GROUP BY b.t, b.s),
vv AS (SELECT pk.t, pk.s, a.id, {', '.join(f'(a.{k} + b.{k}) / 2e0 - c.{k} AS v{k}, c.{k} AS c{k}' for k in 'xyz')}, least(sqrt({d2('a', 'c', scaled=True)}), sqrt({d2('b', 'c', scaled=True)})) AS near FROM pk JOIN mol m ON m.t = pk.t AND m.s = pk.s AND m.o = pk.o JOIN o c ON c.t = pk.t AND c.s = pk.s AND c.o = pk.o JOIN h a ON a.t = pk.t AND a.s = pk.s AND a.h = m.hs[1] JOIN h b ON b.t = pk.t AND b.s = pk.s AND b.h = m.hs[2]),
ww AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n FROM vv),
kk AS (SELECT *, CASE WHEN n > 0 THEN greatest(0e0, ceil((1.1e0 * near / n - 1e0) / 0.05e0 - 1e-9)) ELSE 0e0 END AS k FROM ww),
nw AS (SELECT t, s, id, {', '.join(f'c{k} - (1e0 + 0.05e0 * k) * v{k} AS {k}' for k in 'xyz')} FROM kk)"""


@_query(sql(f"SELECT a.trajectory_id, a.snapshot, a.atom_id, {', '.join(r6(f'coalesce(CASE WHEN w.{k} >= 1e0 THEN w.{k} - 1e0 WHEN w.{k} < 0e0 THEN w.{k} + 1e0 ELSE w.{k} END, a.{k})') + f' AS {k}' for k in 'xyz')} FROM atoms a LEFT JOIN nw w ON w.t = a.trajectory_id AND w.s = a.snapshot AND w.id = a.atom_id WHERE a.snapshot = 4", "", _DSP))
def displace_hydrogen(spark, sf):
    return trajectory(spark, sf).displace(4, 13, target=0.35, eps=0.05).select(*FRAME, "atom_id", *(_r(k) for k in "xyz"))


@_query("SELECT CAST(least(floor((value - 0e0) / 10e0), 19) AS INT) AS bin, 10e0 * least(floor(value / 10e0), 19) AS left_edge, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY ALL")
def value_histogram(spark, sf):
    return stats.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", 0.0, 200.0, 21).where("n > 0")


@_query(f"SELECT CAST(b AS INT) AS bin, {r6('any_value(lo) + b * any_value(step)')} AS left_edge, count(value) AS n FROM (SELECT *, (hi - lo) / 20e0 AS step, unnest(range(0, 20)) AS b FROM (SELECT min(value) AS lo, max(value) AS hi FROM events)) l LEFT JOIN events e ON least(floor((e.value - lo) / step), 19) = b GROUP BY b")
def value_auto_histogram(spark, sf):
    return stats.auto_histogram(spark.read.parquet(f"{sf}/events.parquet"), "value").withColumn("left_edge", _r("left_edge"))
