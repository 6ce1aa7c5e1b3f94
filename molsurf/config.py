"""Physical constants and default parameters."""

# Element order and radii in angstrom, as structure files are read.
ELEMENTS = ("C", "H", "O", "N", "S", "SE")
RADII = (1.70, 1.10, 1.52, 1.55, 1.80, 1.90)
# Radii of the demonstration molecules, and covalent radii of the bond rule d <= 1.25 (ri + rj).
DEMO_RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80}
COVALENT = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "S": 1.05}
BOND_FACTOR = 1.25

PROBE = 1.4
MAX_RADIUS = max(RADII)
EPS = 2.220446049250313e-16
SQRT_EPS = 1.4901161193847656e-08
# The golden angle pi (3 - sqrt 5), the golden ratio's conjugate and the low-discrepancy sequences' steps.
GOLDEN_ANGLE = 2.399963229728653
GOLDEN = 0.6180339887498949
CAP_STEPS = (0.7548776662466927, 0.5698402909980532, 0.137)
SIMPLEX_SHIFT = 0.17320508075688773

ATOM_BLOCK, PAIR_BLOCK, PROBE_BLOCK = 1, 2, 3
ATOM_FILTER, PAIR_FILTER = 256, 24
MAX_SUPPORTS, SUPPORT_TOLERANCE, DEDUP_TOLERANCE = 16, 1e-3, 1e-4
# Voxels of the flood fill at most: of the analytic sampler, and of the others.
ANALYTIC_GRID, MAX_GRID = 50_000_000, 2_000_000
REGRESSION, IMPROVEMENT, COUNT_TOLERANCE = 0.10, 0.05, 0.05
