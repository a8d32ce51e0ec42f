"""TrajectoryFrame: trajectories as two tables, and every analysis as a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dynamics, hbonds, manipulate, molecules, neighbours, rdf, stats
from ..schema import FRAME, HYDROGEN, OXYGEN
from ..session import by_frame
from ..sources import readers, writers


class TrajectoryFrame:
    """atoms and frames of any number of trajectories. Nothing runs before an action; operators that only concern one frame
    work on rows dealt by (trajectory, frame). semantics: documented (default) or as_written."""

    def __init__(self, atoms: DataFrame, frames: DataFrame, semantics: str = "documented"):
        if semantics not in ("documented", "as_written"):
            raise ValueError("semantics must be documented or as_written")
        self.atoms, self.frames, self.as_written = atoms, frames, semantics == "as_written"

    @classmethod
    def read(cls, spark: SparkSession, path, format: str = "lammpstrj", semantics: str = "documented", **options) -> TrajectoryFrame:
        """format: lammpstrj, lammps_data, XDATCAR, gromac, npz or parquet; options go to the reader."""
        by = {"lammpstrj": readers.read_dump, "lammps_data": readers.read_data_file, "XDATCAR": readers.read_xdatcar, "gromac": readers.read_gro, "npz": readers.read_npz, "parquet": readers.read_cache}
        if format not in by:
            raise ValueError(f"format must be one of {sorted(by)}")
        return cls(*by[format](spark, path, **options), semantics)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        return self.atoms, self.frames

    def _with_atoms(self, atoms: DataFrame, snapshot: int) -> TrajectoryFrame:
        """Another set of atoms for one frame: frames keep their boxes, their numbers of atoms are counted anew."""
        n = atoms.groupBy(*FRAME).agg(F.count("*").cast("int").alias("n_atoms"))
        frames = self.frames.where(F.col("snapshot") == snapshot)
        return TrajectoryFrame(atoms, frames.drop("n_atoms").join(n, FRAME).select(frames.columns), "as_written" if self.as_written else "documented")

    def at(self, snapshot: int) -> TrajectoryFrame:
        on = F.col("snapshot") == snapshot
        return TrajectoryFrame(self.atoms.where(on), self.frames.where(on), "as_written" if self.as_written else "documented")

    def cache(self) -> TrajectoryFrame:
        """Keeps the assignment of hydrogens, which nearly every analysis needs."""
        self.assignment.persist()
        return self

    # ------------------------------------------------------------ shared plans

    @cached_property
    def _dealt(self) -> DataFrame:
        box = self.frames.select(*FRAME, "lx", "ly", "lz")
        return by_frame(self.atoms.join(box, FRAME))

    def _species(self, kind: int) -> DataFrame:
        w = Window.partitionBy(*FRAME).orderBy("ord")
        a = self._dealt.where(F.col("atom_type") == kind)
        return a.select(*FRAME, (F.row_number().over(w) - 1).cast("int").alias("idx"), F.col("atom_id").alias("id"), "ord", "x", "y", "z", "lx", "ly", "lz")

    @cached_property
    def h(self) -> DataFrame:
        return self._species(HYDROGEN)

    @cached_property
    def o(self) -> DataFrame:
        return self._species(OXYGEN)

    @cached_property
    def counts(self) -> DataFrame:
        return self.atoms.groupBy(*FRAME).agg(F.count(F.when(F.col("atom_type") == HYDROGEN, 1)).alias("n_h"), F.count(F.when(F.col("atom_type") == OXYGEN, 1)).alias("n_o"))

    @cached_property
    def assignment(self) -> DataFrame:
        return self.nearest_neighbour()

    @cached_property
    def molecules(self) -> DataFrame:
        return molecules.molecules(self.o, self.assignment)

    @cached_property
    def ions(self) -> DataFrame:
        return molecules.ions(self.molecules, carry=self.as_written)

    @cached_property
    def first_ions(self) -> DataFrame:
        return molecules.ions(self.molecules, first=True)

    @cached_property
    def recombination(self) -> DataFrame:
        return molecules.recombination(self.molecules)

    @cached_property
    def centres(self) -> DataFrame:
        return molecules.centres(self.o, self.h, self.assignment)

    @cached_property
    def atoms_with_molecule(self) -> DataFrame:
        """Atoms with mol (the index of their oxygen), n_h and box edges."""
        hy = self.h.join(self.assignment.select(*FRAME, F.col("h_idx").alias("idx"), F.col("o_idx").alias("mol")), [*FRAME, "idx"]).withColumn("atom_type", F.lit(HYDROGEN))
        ox = self.o.withColumn("mol", F.col("idx")).withColumn("atom_type", F.lit(OXYGEN))
        cols = [*FRAME, "ord", F.col("id").alias("atom_id"), "atom_type", "x", "y", "z", "mol", "lx", "ly", "lz"]
        both = hy.select(*cols).unionByName(ox.select(*cols))
        return both.join(self.molecules.select(*FRAME, F.col("o_idx").alias("mol"), "n_h"), [*FRAME, "mol"])

    def before(self, df: DataFrame) -> DataFrame:
        return molecules.before(df, self.recombination)

    # ------------------------------------------------------------ neighbours, molecules, ions

    def box_size(self) -> DataFrame:
        return self.frames.select(*FRAME, "lx", "ly", "lz")

    def species(self, kind: int) -> DataFrame:
        return self.h if kind == HYDROGEN else self.o

    def nearest_neighbour(self, mode: str = "pbc", cell: float | None = None) -> DataFrame:
        return neighbours.nearest(self.h, self.o, mode, cell)

    nearest_neighbour_naive = nearest_neighbour

    def k_nearest(self, k: int = 19) -> DataFrame:
        return neighbours.k_nearest(self.o, k)

    def ion_distance(self) -> DataFrame:
        return molecules.ion_distance(self.ions, self.o)

    def recombination_time(self) -> DataFrame:
        return self.recombination

    def water_histogram(self) -> DataFrame:
        return molecules.hydrogen_histogram(self.molecules)

    # ------------------------------------------------------------ radial distribution

    def rdf(self, gr_type: str = "OO", n_bins: int = 50, start: float = 0.01, stop: float | None = None, snapshot: int | None = None, per_frame: bool = False) -> DataFrame:
        return rdf.rdf(self, gr_type, n_bins, start, stop, snapshot, per_frame)

    def rdf_by_increment(self, gr_type: str = "OO", increment: float = 0.005, start: float = 0.01, stop: float = 4.0) -> DataFrame:
        return rdf.rdf(self, gr_type, int(round((stop - start) / increment)) + 1, start, stop)

    def averaged_rdf(self, gr_types=("OO",), n_bins: int = 50, start: float = 0.01, stop: float = 8.0) -> DataFrame:
        return rdf.averaged(self, gr_types, n_bins, start, stop)

    # ------------------------------------------------------------ dynamics

    def msd(self, unwrap: bool = False) -> DataFrame:
        return dynamics.msd(self.centres, unwrap)

    def rotational_diffusion(self, timestep: float = 0.0005) -> DataFrame:
        return dynamics.rotational(self.o, self.h, self.assignment, timestep, shifted=not self.as_written, clip=not self.as_written)

    def translational_diffusion(self, timestep: float = 0.0005, eps: float = 0.1) -> DataFrame:
        return dynamics.diffusion_constant(self.msd(), timestep, eps)

    def ion_speed(self, dt: float = 0.0005) -> DataFrame:
        return self.before(dynamics.ion_speed(self.centres, self.before(self.ions), dt, fold=not self.as_written))

    def ion_track(self, kind: str = "h3o") -> DataFrame:
        return dynamics.ion_track(self.before(self.ions), self.o, kind)

    def jump_trace(self, kind: str = "h3o") -> DataFrame:
        return dynamics.jumps(self.ion_track(kind))

    def diffusion_distance(self, kind: str = "h3o") -> DataFrame:
        return dynamics.diffusion_runs(self.ion_track(kind), flush_last=not self.as_written)

    def jump_distance(self, kind: str = "h3o") -> DataFrame:
        return dynamics.jump_distances(self.ion_track(kind), self.as_written)

    # ------------------------------------------------------------ hydrogen bonds

    def hbond_edges(self, cutoff: float = 3.6, min_angle: float = 150.0) -> DataFrame:
        return hbonds.edges(self.o, self.h, self.assignment, cutoff, min_angle, self.as_written)

    def hbond_network(self, root: str = "h3o", cutoff: float = 3.6) -> DataFrame:
        return hbonds.network(self.hbond_edges(cutoff), self.ions, root)

    def hb_timeseries(self, cutoff: float = 2.9) -> DataFrame:
        e, i = self.hbond_edges(cutoff), self.before(self.ions)
        return hbonds.network(e, i, "oh").unionByName(hbonds.network(e, i, "h3o"))

    def hb_ratio(self, cutoff: float = 2.9) -> DataFrame:
        return hbonds.bond_ratio(self.hb_timeseries(cutoff), self.before(self.frames))

    def wires(self, cutoff: float = 2.9) -> DataFrame:
        return hbonds.wires(self.hbond_edges(cutoff), self.before(self.ions))

    def last_wire(self, cutoff: float = 2.9) -> DataFrame:
        return hbonds.last_wire(self.wires(cutoff))

    def wire_distances(self, cutoff: float = 2.9) -> DataFrame:
        return hbonds.wire_distances(self.wires(cutoff), self.o)

    def wire_lifetimes(self, cutoff: float = 2.9, include_open: bool = False) -> DataFrame:
        return hbonds.lifetimes(self.wires(cutoff), include_open=include_open)

    def transition_ions(self, root: str = "h3o", cutoff: float = 3.0) -> DataFrame:
        return hbonds.transition_ions(self.hbond_edges(cutoff), self.before(self.ions), self.molecules, root)

    # ------------------------------------------------------------ editing and export

    def expand(self, snapshot: int = 0, remove_ions: bool = True) -> TrajectoryFrame:
        """In length units; see manipulate.expand."""
        return TrajectoryFrame(*manipulate.expand(self, snapshot, remove_ions))

    def remove_molecules(self, n: int = 1, snapshot: int = 0, o_ids: list[int] | None = None, seed: int = 0) -> TrajectoryFrame:
        return self._with_atoms(manipulate.remove_molecules(self, n, snapshot, o_ids, seed), snapshot)

    def remove_from_expanded(self, n: int, snapshot: int = 0, seed: int = 0) -> TrajectoryFrame:
        return manipulate.remove_from_expanded(self, n, snapshot, seed)

    def grouped(self) -> TrajectoryFrame:
        return TrajectoryFrame(manipulate.grouped(self), self.frames)

    def displace(self, snapshot: int = 0, o_idx: int | None = None, target: float = 0.05, eps: float = 0.01, seed: int = 0, copies: int = 1) -> DataFrame:
        return manipulate.displace(self, snapshot, o_idx, target, eps, seed, copies)

    def fill_hydroxide(self, snapshot: int = 0, angle: float = 104.5, length: float = 0.96, seed: int = 0) -> TrajectoryFrame:
        return self._with_atoms(manipulate.fill_hydroxide(self, snapshot, angle, length, seed), snapshot)

    def write(self, path: str, format: str = "lammpstrj", **options) -> None:
        """format: lammpstrj, lammps_data (option snapshot), XDATCAR or parquet."""
        by = {"lammpstrj": writers.write_dump, "lammps_data": writers.write_data_file, "XDATCAR": writers.write_xdatcar, "parquet": writers.write_cache}
        by[format](self.atoms, self.frames, path, **options)
