"""Fixed values of the analysis: cohorts, trims, guards, methods."""

# Fixed values.
CLASSES = (0, 1, 2, 3, 4)
FIELDS = ("1", "2", "3", "4")
COMMON_FIELDS = ("1", "2", "3")
REFERENCE_ALTITUDE = 60
ALTITUDES = (20, 40, 60, 80, 100, 120)
SENSORS = {"1": "L1", "L1": "L1", "2": "H300", "H300": "H300"}
Z_TRIM = (0.001, 0.999)
XY_TRIM = (0.01, 0.99)
MIDPOINT = 0.50
EPS = 1e-8
CONTEXT_EPS = 1e-12
MIN_POINTS = 50
CORE_FACTOR, CORE_POINTS = 0.25, 30
GRID, GRID_POINTS, GRID_CELLS, GRID_SHARE = 5, 20, 6, 0.20
RINGS, SECTORS, POLAR_POINTS, POLAR_CELLS = 5, 8, 15, 8
BINS, BIN = 20, 0.05
MIN_HEIGHT, HEIGHT_BIN = 0.50, 0.15
SCHEMES = ["five_class", "merge01"]
FIELD_NAMES = {"1": "DKSB", "2": "PBOV", "3": "BTMS", "4": "BTMN"}
FOLDS, REPEATS, TREES, SEED, RESAMPLES = 5, 10, 300, 42, 3000
Z95 = 1.959963984540054
METHODS = {
    "VRI_Threshold": ("THRESHOLD", ["VRI"]),
    "GlobalPF_Threshold": ("THRESHOLD", ["GlobalPF50"]),
    "GlobalPF_LR": ("LR", ["GlobalPF50"]),
    "CorePF_LR": ("LR", ["CorePF50"]),
    "Prevalence_LR": ("LR", ["PGF50"]),
    "LocalTail_LR": ("LR", ["CPC90"]),
    "MidpointCompact_LR": ("LR", ["CorePF50", "PGF50"]),
    "MidpointExtended_LR": ("LR", ["CorePF50", "PGF50", "CPC90"]),
    "MidpointCompact_RF": ("RF", ["CorePF50", "PGF50"]),
}
PAIRS = [("MidpointCompact_LR", "GlobalPF_Threshold"), ("MidpointExtended_LR", "MidpointCompact_LR"), ("MidpointCompact_RF", "MidpointCompact_LR")]
ALTITUDE_METHODS = ["MidpointCompact_LR", "MidpointExtended_LR"]
SENSOR_METHODS = ["GlobalPF_LR", "CorePF_LR", "MidpointCompact_LR", "MidpointExtended_LR"]
