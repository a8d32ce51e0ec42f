"""The two tables that hold trajectories."""

ATOMS = "trajectory_id BIGINT, snapshot BIGINT, ord INT, atom_id BIGINT, atom_type INT, x DOUBLE, y DOUBLE, z DOUBLE"
FRAMES = (
    "trajectory_id BIGINT, snapshot BIGINT, timestep BIGINT, n_atoms INT, xlo DOUBLE, xhi DOUBLE, ylo DOUBLE, yhi DOUBLE, "
    "zlo DOUBLE, zhi DOUBLE, lx DOUBLE, ly DOUBLE, lz DOUBLE"
)
FRAME = ["trajectory_id", "snapshot"]
HYDROGEN, OXYGEN = 1, 2
# Atomic masses in u; the second pair stands in the header of data files.
MASS_H, MASS_O = 1.00784, 15.999
HEADER_MASSES = ("1.00794005", "15.9994001")
