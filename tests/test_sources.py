import numpy as np
import pytest
from pyspark.sql import functions as F

from aquilon.plans import queries as Q
from aquilon.plans.batch import averaged_rdf, fill_hydroxides, generate_inputs
from aquilon.plans.trajectory import TrajectoryFrame
from aquilon.sources import readers, writers

DUMP = """ITEM: TIMESTEP
0
ITEM: NUMBER OF ATOMS
3
ITEM: BOX BOUNDS pp pp pp
-1.0 9.0
0.0 10.0
0.0 10.0 0.5
ITEM: ATOMS id type xs ys zs vx
3 2 0.5 0.5 0.5 9
1 1 1.0 -0.05 2.5 9
2 1 0.55 0.5 0.5 9
7 1 0.1 0.1 0.1 9
ITEM: TIMESTEP
500
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
0 10
0 10
0 10
ITEM: ATOMS id type x y z
1.0 1.0 1 2 3
2.0 2.0 10 -1 5
"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_dump(spark, tmp_path):
    (tmp_path / "a.lammpstrj").write_text(DUMP.rstrip("\n"))
    atoms, frames = readers.read_dump(spark, str(tmp_path / "a.lammpstrj"))
    assert rows(frames, "snapshot", "timestep", "n_atoms", "surplus", "tilted", "lx") == [(0, 0, 3, 1, True, 10.0), (1, 500, 2, 0, False, 10.0)]
    assert rows(atoms.where("snapshot = 0"), "ord", "atom_id", "atom_type", "x", "y", "z") == [(0, 3, 2, 0.5, 0.5, 0.5), (1, 1, 1, 0.0, 0.95, 1.5), (2, 2, 1, 0.55, 0.5, 0.5)]
    assert rows(atoms.where("snapshot = 1"), "atom_id", "x", "y", "z") == [(1, 0.1, 0.2, 0.3), (2, 0.0, 0.9, 0.5)]
    one, _ = readers.read_dump(spark, str(tmp_path / "a.lammpstrj"), coords="raw", snapshot=1)
    assert rows(one, "atom_id", "x") == [(1, 1.0), (2, 10.0)]
    assert [t.count() for t in readers.read_dump(spark, _empty(tmp_path))] == [0, 0]
    with pytest.raises(ValueError):
        readers.read_dump(spark, str(tmp_path / "a.lammpstrj"), coords="odd")


def _empty(tmp_path):
    (tmp_path / "none.lammpstrj").write_text("")
    return str(tmp_path / "none.lammpstrj")


def test_data_file(spark, tmp_path):
    (tmp_path / "w.data").write_text("title # x\n\n 3 atoms\n 2 atom types\n\n0 10 xlo xhi\n0 20.0 ylo yhi\n-5 5 zlo zhi\n\nMasses\n\n1 1.0\n2 16.0\n\nAtoms # atomic\n\n1 1 1 2 0 # h\n2 1 2 4 0\n3 2 5 10 -5\n\nVelocities\n\n1 0 0 0\n")
    atoms, frames = readers.read_data_file(spark, str(tmp_path / "w.data"))
    assert rows(frames, "n_atoms", "lx", "ly", "lz", "zlo") == [(3, 10.0, 20.0, 10.0, -5.0)]
    assert rows(atoms, "atom_id", "atom_type", "x", "y", "z") == [(1, 1, 0.1, 0.1, 0.5), (2, 1, 0.2, 0.2, 0.5), (3, 2, 0.5, 0.5, 0.0)]


def test_xdatcar_and_gro(spark, tmp_path):
    (tmp_path / "X").write_text("unknown\n 1.0\n 10 0 0\n 0 10 0\n 0 0 12\n O H\n 1 2\nDirect configuration=     1\n0.5 0.5 0.5\n0.6 0.5 0.5\n0.4 0.5 0.5\nDirect configuration=     2\n0.1 0.1 0.1\n0.2 0.2 0.2\n0.3 0.3 0.3\n")
    atoms, frames = readers.read_xdatcar(spark, str(tmp_path / "X"))
    assert rows(frames, "snapshot", "timestep", "n_atoms", "lz") == [(0, 1, 3, 12.0), (1, 2, 3, 12.0)]
    assert rows(atoms.where("snapshot = 1"), "atom_id", "atom_type", "x") == [(1, 2, 0.1), (2, 1, 0.2), (3, 1, 0.3)]
    g = "Generated by test : t= 0.0\n 3\n    1SOL    OW1    1   0.500   0.500   0.500\n    1SOL    HW2    2   0.600   0.500   0.500\n    1SOL    HW3    3   0.400   0.500   0.500\n   1.00000   1.00000   1.00000\n"
    (tmp_path / "a.gro").write_text(g + g.replace("t= 0.0", "t= 1.0"))
    atoms, frames = readers.read_gro(spark, str(tmp_path / "a.gro"))
    assert frames.count() == 2 and rows(atoms.where("snapshot = 0"), "atom_type", "x") == [(1, 0.4), (1, 0.6), (2, 0.5)]


def test_npz_and_series(spark, tmp_path):
    a = np.arange(30, dtype=float).reshape(2, 3, 5)
    np.savez(tmp_path / "t.npz", atom_list=a, box_dim=np.tile([[0.0, 2.0]], (2, 3, 1)), n_atoms=3)
    t = TrajectoryFrame.read(spark, str(tmp_path / "t.npz"), "npz")
    assert t.atoms.count() == 6 and rows(t.frames, "snapshot", "lx") == [(0, 2.0), (1, 2.0)]
    s = spark.createDataFrame([(0, 1.5), (1, 2.5)], "pos long, value double")
    writers.write_series(s, str(tmp_path / "s"))
    assert rows(readers.read_series(spark, str(tmp_path / "s")), "pos", "value") == [(0, 1.5), (1, 2.5)]


@pytest.mark.parametrize("fmt", ["lammpstrj", "lammps_data", "XDATCAR", "parquet"])
def test_round_trip(spark, sf, tmp_path, fmt):
    t = Q.trajectory(spark, sf)
    one = TrajectoryFrame(t.atoms.where("trajectory_id = 0 AND snapshot = 0"), t.frames.where("trajectory_id = 0 AND snapshot = 0"))
    one.write(str(tmp_path / "o"), fmt)
    back = TrajectoryFrame.read(spark, str(tmp_path / "o"), fmt)
    key = lambda d: sorted((r.atom_type, round(r.x, 9) % 1, round(r.y, 9) % 1, round(r.z, 9) % 1) for r in d.collect())
    assert key(back.atoms) == key(one.atoms)
    assert rows(back.molecules.groupBy("n_h").count(), "n_h", "count") == rows(one.molecules.groupBy("n_h").count(), "n_h", "count")


def test_files_of_many_frames_and_folders(spark, sf, tmp_path):
    t = Q.trajectory(spark, sf)
    for k in (0, 1):
        a = TrajectoryFrame(t.atoms.where(f"trajectory_id = {k}"), t.frames.where(f"trajectory_id = {k}"))
        writers.write_dump(a.grouped().atoms, a.frames, str(tmp_path / f"g{k}"), timestep=5000)
        text = "".join(p.read_text() for p in sorted((tmp_path / f"g{k}").glob("part-*")))
        d = tmp_path / "tree" / f"run_{k}"
        d.mkdir(parents=True)
        a.write(str(tmp_path / f"w{k}"))
        (d / "trj.lammpstrj").write_text("".join(p.read_text() for p in sorted((tmp_path / f"w{k}").glob("part-*"))))
        assert text.count("ITEM: TIMESTEP") == a.frames.count()
    g, times = averaged_rdf(spark, str(tmp_path / "tree"), "run_", "trj.lammpstrj", ("OO",), stop=4.65, save=str(tmp_path / "rdf"))
    want = {r.bin: r.g for r in t.averaged_rdf(("OO",), stop=4.65).collect()}
    assert all(abs(r.g - want[r.bin]) < 1e-6 for r in g.collect()) and rows(times, "recombination_time") == [(8,)]
    back = readers.read_rdf(spark, str(tmp_path / "rdf"))
    assert back.count() == 49 and {r.label for r in back.collect()} == {"OO"}
    writers.write_data_files(t.atoms.where("trajectory_id = 0"), t.frames.where("trajectory_id = 0"), str(tmp_path / "cut"), [0, 3])
    assert sorted(p.name for p in (tmp_path / "cut").glob("snapshot=*")) == ["snapshot=0", "snapshot=3"]
    generate_inputs(t.at(0), str(tmp_path / "gen"), 2)
    assert len(list((tmp_path / "gen").glob("copy=*/trajectory_id=*"))) == 4
    fill = fill_hydroxides(spark, str(tmp_path / "cut" / "snapshot=0"), str(tmp_path / "filled"))
    assert rows(fill.molecules.groupBy("n_h").count(), "n_h", "count") == [(2, 26), (3, 1)]


def test_dump_text(spark, sf):
    t = Q.trajectory(spark, sf)
    lines = [r.value for r in writers.dump_lines(t.atoms.where("trajectory_id = 0 AND snapshot = 2"), t.frames.where("trajectory_id = 0 AND snapshot = 2"), 5000).orderBy("seq").collect()]
    assert lines[:5] == ["ITEM: TIMESTEP", "10000", "ITEM: NUMBER OF ATOMS", "81", "ITEM: BOX BOUNDS pp pp pp"] and lines[5] == "0.0 9.3"
    assert lines[8] == "ITEM: ATOMS id type xs ys zs" and lines[9].startswith("1.0 1.0 ") and len(lines) == 90


def test_stream_reads_cartesian_dumps_like_the_batch_reader(spark, tmp_path):
    from aquilon.sources.readers import read_dump
    from aquilon.streaming import frames as S

    box = "ITEM: BOX BOUNDS pp pp pp\n1 11\n0 10\n-5 5\n"
    (tmp_path / "a.dump").write_text("".join(f"ITEM: TIMESTEP\n{k}\nITEM: NUMBER OF ATOMS\n2\n{box}ITEM: ATOMS id type x y z\n1 2 6 2 {k}\n2 1 1.5 9.5 -4\n" for k in range(3)))
    q = S.tables(S.dump_stream(spark, str(tmp_path)))[0].writeStream.format("memory").queryName("cartesian").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    pick = lambda df: sorted((r.snapshot, r.ord, r.atom_id, r.atom_type, r.x, r.y, r.z) for r in df.collect())
    got = pick(spark.table("cartesian"))
    assert got == pick(read_dump(spark, str(tmp_path / "a.dump"))[0]) and got[0][4:] == (0.5, 0.2, 0.5)


def test_atoms_are_counted_anew(spark, sf):
    from aquilon.plans.queries import trajectory

    t = trajectory(spark, sf)
    assert {r.n_atoms for r in t.remove_molecules(5, 9).frames.collect()} == {66}
    assert {r.n_atoms for r in t.fill_hydroxide(2).frames.collect()} == {82}
