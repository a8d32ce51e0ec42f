import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquilon.operators import dynamics, hbonds, manipulate, neighbours, plotdata, stats
from aquilon.plans import queries as Q
from aquilon.plans.trajectory import TrajectoryFrame
from aquilon.schema import ATOMS, FRAMES
from aquilon.streaming import frames as stream


def make(spark, atoms, n=1, edge=10.0):
    """atoms: (trajectory, snapshot, ord, id, type, x, y, z)."""
    keys = sorted({a[:2] for a in atoms})
    f = [(t, s, s, sum(a[:2] == (t, s) for a in atoms), 0.0, edge, 0.0, edge, 0.0, edge, edge, edge, edge) for t, s in keys]
    return TrajectoryFrame(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(f, FRAMES))


@pytest.fixture(scope="module")
def t(spark, sf):
    return Q.trajectory(spark, sf)


def test_three_cells_are_one(spark):
    """Where the halo of a cell is the whole box, no atom is repeated; the nearest are found all the same, within the cell's edge or not."""
    rng = np.random.default_rng(6)
    p = rng.random((20, 3)) * [1, 1, 0.3]
    t = make(spark, [(0, 0, i, i + 1, 2 if i in (0, 5, 10) else 1, *map(float, p[i])) for i in range(20)])
    assert [neighbours.cells(t.h, edge, True).count() for edge in (3.3, 2.5)] == [17, 17 * 27]
    want = {(r.h_idx, r.o_idx) for r in t.nearest_neighbour().collect()}
    for cell in (3.3, 2.5, 1.0):
        assert {(r.h_idx, r.o_idx) for r in t.nearest_neighbour(cell=cell).collect()} == want and len(want) == 17


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.random((60, 3))
    atoms = [(0, 0, i, i + 1, 2 if i % 3 == 0 else 1, *map(float, p[i])) for i in range(60)]
    t = make(spark, atoms)
    o, h = p[::3], np.array([p[i] for i in range(60) if i % 3])
    for mode in ("pbc", "normal"):
        d = h[:, None] - o[None]
        d = d - np.round(d) if mode == "pbc" else d
        dist = np.sqrt((d**2).sum(2)) * 10
        for cell in (None, 2.0, 0.3):
            got = {r.h_idx: (r.o_idx, r.dist) for r in t.nearest_neighbour(mode, cell).collect()}
            assert all(got[i][0] == dist[i].argmin() and abs(got[i][1] - dist[i].min()) < 1e-9 for i in range(len(h)))
    counts = np.bincount(((((h[:, None] - o[None]) + 0.5) % 1 - 0.5) ** 2).sum(2).argmin(1), minlength=len(o))
    assert {r.o_idx: r.n_h for r in t.molecules.collect()} == dict(enumerate(counts.tolist()))


def test_ties_bare_oxygens_and_no_ions(spark):
    t = make(spark, [(0, 0, 0, 1, 2, 0.1, 0.5, 0.5), (0, 0, 1, 2, 2, 0.3, 0.5, 0.5), (0, 0, 2, 3, 1, 0.2, 0.5, 0.5), (0, 0, 3, 4, 1, 0.2, 0.5, 0.5)])
    assert sorted((r.o_idx, r.n_h, list(r.h_list)) for r in t.molecules.collect()) == [(0, 2, [0, 1]), (1, 0, [])]
    assert tuple(t.ions.select("oh", "h3o").first()) == (None, None)
    assert tuple(t.recombination.first()) == (0, 1, False)
    assert t.ion_distance().first().dist_scaled is None and t.wires().first().length == 0
    assert t.ion_speed().count() == 0 and t.hb_ratio(3.0).count() == 1


def test_empty(spark):
    t = TrajectoryFrame(spark.createDataFrame([], ATOMS), spark.createDataFrame([], FRAMES))
    for df in (t.assignment, t.molecules, t.recombination, t.rdf("OO", stop=4.0), t.msd(), t.hbond_edges(3.2), t.wires(3.2), t.jump_trace(), t.ion_speed(), t.rotational_diffusion()):
        assert df.count() == 0


def test_lattice_rdf(spark):
    n, edge = 5, 10.0
    g = [(i / n, j / n, k / n) for i in range(n) for j in range(n) for k in range(n)]
    t = make(spark, [(0, 0, i, i, 2, *p) for i, p in enumerate(g)], edge=edge)
    got = {r.bin: r.g for r in t.rdf("OO", n_bins=50, stop=4.9).collect()}
    step, rho = (4.9 - 0.01) / 49, n**3 / edge**3
    p = np.array(g)
    d = p[0] - p
    d = np.sqrt((((d + 0.5) % 1 - 0.5) ** 2).sum(1)) * edge
    hist, edges = np.histogram(d[d > 0.01], np.linspace(0.01, 4.9, 50))
    want = hist / (4 * math.pi / 3 * (edges[1:] ** 3 - edges[:-1] ** 3)) / rho
    assert len(got) == 49 and np.allclose([got[i] for i in range(49)], want) and step > 0


def test_linear_motion(spark):
    atoms = []
    for s in range(6):
        x = 0.2 + 0.05 * s
        atoms += [(0, s, 0, 1, 2, x, 0.5, 0.5), (0, s, 1, 2, 1, x + 0.05, 0.5, 0.5), (0, s, 2, 3, 1, x - 0.05, 0.5, 0.5)]
    t = make(spark, atoms)
    m = {r.snapshot: r.msd for r in t.msd().collect()}
    assert all(abs(m[s] - (0.05 * s) ** 2) < 1e-12 for s in range(6))
    w = {r.snapshot: r.msd for r in make(spark, [(*a[:5], (a[5] + 0.55) % 1, a[6], a[7]) for a in atoms]).msd(unwrap=True).collect()}
    assert len(w) == 6
    assert tuple(t.recombination.first()) == (0, 0, True)


def test_unwrap_recovers_a_line(spark):
    df = spark.createDataFrame([(0, s, 1, (0.4 * s) % 1, 0.0, 0.0) for s in range(10)], "trajectory_id long, snapshot long, atom_id long, x double, y double, z double")
    assert [round(r.x, 9) for r in dynamics.unwrap(df).orderBy("snapshot").collect()] == [round(0.4 * s, 9) for s in range(10)]


def test_box_translation_and_order_change_nothing(spark, t):
    moved = TrajectoryFrame(t.atoms.withColumns({k: F.col(k) + 0.25 - F.floor(F.col(k) + 0.25) for k in "xyz"}), t.frames)
    turned = TrajectoryFrame(t.atoms.withColumn("ord", (F.col("ord") + 1000 * F.col("atom_type")).cast("int")).orderBy(F.rand(1)), t.frames)
    ids = lambda a: {(r.trajectory_id, r.snapshot, r.h_id, r.o_id) for r in a.assignment.collect()}
    assert ids(moved) == ids(t) == ids(turned)
    e = lambda a: {tuple(r) for r in a.hbond_edges(3.2).collect()}
    assert e(moved) == e(t)


def test_invariants(t):
    n = {(r.trajectory_id, r.snapshot): r.s for r in t.molecules.groupBy("trajectory_id", "snapshot").agg(F.sum("n_h").alias("s")).collect()}
    assert set(n.values()) == {54}
    w = t.wires(3.2)
    ends = w.where("length > 0").join(t.ions, ["trajectory_id", "snapshot"]).select("path", "oh", "h3o", "length").collect()
    assert ends and all(r.path[0] == r.h3o and r.path[-1] == r.oh and len(r.path) == r.length for r in ends)
    j = t.jump_trace().groupBy("trajectory_id").count().collect()
    assert {r["count"] for r in j if r.trajectory_id == 0} == {7}


def test_graph_helpers():
    src, dst = [0, 0, 1, 2, 3, 5], [1, 2, 3, 3, 4, 6]
    assert hbonds.reached(src, dst, 0) == [0, 1, 2, 3, 4] and hbonds.reached(src, dst, None) == []
    assert hbonds.shortest(src, dst, 0, 4) == [0, 1, 3, 4] and hbonds.shortest(src, dst, 0, 6) is None and hbonds.shortest(src, dst, 0, 0) == [0]
    order = hbonds.depth_first(src, dst, 0)
    assert set(order) == {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)} and order[0] == (0, 1)


def test_search_order_and_mirrors(t):
    e = t.hbond_edges(3.2)
    s = hbonds.search_order(e, t.ions, "h3o")
    net = hbonds.network(e, t.ions, "h3o")
    key = ["trajectory_id", "snapshot", "src_o", "dst_o"]
    assert {tuple(r) for r in s.select(*key).collect()} == {tuple(r) for r in net.select(*key).collect()}
    assert hbonds.first_of_mirrors(s).count() == hbonds.mirror_free(net).count()


def test_islands_and_lifetimes(spark):
    w = spark.createDataFrame([(0, s, n, None) for s, n in enumerate([0, 3, 3, 0, 2, 0, 4, 4, 4])], "trajectory_id long, snapshot long, length int, path array<int>")
    assert sorted(r.lifetime for r in hbonds.lifetimes(w).collect()) == [1, 2]
    assert sorted(r.lifetime for r in hbonds.lifetimes(w, include_open=True).collect()) == [1, 2, 3]
    assert sorted(r.snapshot for r in hbonds.last_wire(w).collect()) == [6, 7, 8]


def test_series(spark):
    x = np.array([1.0, 3.0, 2.0, 5.0, 4.0])
    s = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "trajectory_id long, snapshot long, value double")
    m = x.mean()
    want = np.array([np.mean((x[: 5 - k] - m) * (x[k:] - m)) for k in range(5)])
    got = [r.acf for r in stats.acf(s, "value").orderBy("lag").collect()]
    assert np.allclose(got, want / want[0])
    y = x[1:]
    full = np.correlate(x - m, y - y.mean(), "full")
    full = full[full.size // 2 :] / np.sqrt(((x - m) ** 2).sum() * ((y - y.mean()) ** 2).sum())
    c = stats.cross_correlation(s, s.where("snapshot > 0")).orderBy("lag").collect()
    assert np.allclose([r.correlation for r in c], full)
    h = [r.hma for r in stats.hull(s, "value", 4).orderBy("snapshot").collect()]
    w4, w2 = (x[:4] * [1, 2, 3, 4]).sum() / 10, lambda a: (a * [1, 2]).sum() / 3
    assert h[:4] == [0.0] * 4 and abs(h[4] - (2 * w2(x[2:4]) - w4 + 2 * w2(x[3:]) - (x[1:] * [1, 2, 3, 4]).sum() / 10) / 2) < 1e-12
    assert [r.n for r in stats.auto_histogram(s, "value", 4).orderBy("bin").collect()] == [1, 1, 1, 2]


def test_jump_of_one_hop(spark):
    tr = spark.createDataFrame([(0, s, i, x, 0.0, 0.0, 10.0, 10.0, 10.0) for s, (i, x) in enumerate([(7, 0.1), (7, 0.2), (9, 0.5), (9, 0.6), (9, 0.7)])], "trajectory_id long, snapshot long, ion_id long, x double, y double, z double, lx double, ly double, lz double")
    assert [(r.snapshot, r.is_jump) for r in dynamics.jumps(tr).orderBy("snapshot").collect()] == [(0, False), (1, True), (2, False), (3, False)]
    assert [round(r.distance, 9) for r in dynamics.jump_distances(tr).collect()] == [0.3]
    assert [round(r.distance, 9) for r in dynamics.jump_distances(tr, as_written=True).collect()] == [0.1]
    assert sorted((r.start, r.end) for r in dynamics.diffusion_chunks(tr).collect()) == [(0, 1), (2, 4)]
    d, j = dynamics.stitched(tr)
    assert [round(r.x, 9) for r in d.orderBy("pos").collect()] == [1.0, 1.0, 2.0, 3.0] and [round(r.x, 9) for r in j.orderBy("pos").collect()] == [0.0, 3.0]


def test_editing(t):
    one = t.remove_molecules(1, 2, seed=3).atoms.groupBy("trajectory_id").count().collect()
    assert all(77 <= r["count"] <= 79 for r in one)
    assert t.expand(9).atoms.where("trajectory_id = 0").count() == 8 * 81
    big = t.remove_from_expanded(5, 9)
    assert big.atoms.where("trajectory_id = 0").count() == 8 * 81 - 15
    c = t.displace(4, None, target=0.35, eps=0.05, copies=2, seed=1)
    was = t.atoms.select("trajectory_id", "snapshot", "atom_id", F.col("x").alias("wx"), F.col("y").alias("wy"))
    moved = c.join(was, ["trajectory_id", "snapshot", "atom_id"]).where("abs(x - wx) + abs(y - wy) > 1e-9")
    assert c.count() == 2 * t.atoms.where("snapshot = 4").count() and 0 < moved.count() <= 2 * t.frames.where("snapshot = 4").count()
    assert manipulate.labelled_network(t, 3.2).where("atom_type > 2").count() > 0
    assert manipulate.select_atoms(t, t.atoms.where("atom_id = 3").select("trajectory_id", "snapshot", "atom_id")).count() == t.frames.count()


def test_plot_data(t):
    m = plotdata.msd_data(t, 0.5).where("trajectory_id = 0").orderBy("snapshot").collect()
    assert m[0].time == 0.0 and abs(m[-1].time - 5.0) < 1e-12
    for df in (plotdata.ion_distance_data(t), plotdata.rotational_data(t), plotdata.ion_speed_data(t), plotdata.rdf_data(t, stop=4.0), plotdata.hbonds_single_data(t, 1, cutoff=3.2), plotdata.hb_network_data(t, 3.2), plotdata.hb_ratio_data(t, 3.2, 5), plotdata.hb_wire_data(t, 3.2), plotdata.wire_length_data(t, 3.2), plotdata.hb_distances_data(t, 3.2), plotdata.transition_data(t, cutoff=3.2), plotdata.water_hist_data(t)):
        assert df.columns and df.limit(1).count() >= 0


def test_as_written(spark, sf):
    t = Q.trajectory(spark, sf, "as_written")
    assert t.ion_speed().count() > 0 and t.rotational_diffusion().count() == t.frames.count() and t.jump_distance().count() > 0 and t.diffusion_distance().count() >= 0
    with pytest.raises(ValueError):
        TrajectoryFrame(t.atoms, t.frames, "other")


def test_stream_equals_batch(spark, sf, tmp_path):
    t = Q.trajectory(spark, sf)
    a = TrajectoryFrame(t.atoms.where("trajectory_id = 0"), t.frames.where("trajectory_id = 0"))
    a.write(str(tmp_path / "w"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dump").write_text("".join(p.read_text() for p in sorted((tmp_path / "w").glob("part-*"))))
    got = []
    q = stream.each_batch(stream.dump_stream(spark, str(tmp_path / "in")), lambda tf, n: got.extend((r.snapshot, r.oh, r.h3o) for r in tf.ions.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got, key=repr) == sorted(((r.snapshot, r.oh, r.h3o) for r in a.ions.collect()), key=repr)
    track = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (0, 2, 9)], "trajectory_id long, snapshot long, ion_id long")
    track.coalesce(1).write.parquet(str(tmp_path / "tr"))
    s = stream.jumps(spark.readStream.schema(track.schema).parquet(str(tmp_path / "tr")))
    q = s.writeStream.format("memory").queryName("jumps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("jumps").collect()] == [(0, 1, 7, 9)]
