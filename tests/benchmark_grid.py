"""The published eight-substation benchmark case for induced currents."""

INF = float("inf")

# Lines (name, from bus, to bus, ohm, kV).
LINES = [
    ("1", 2, 3, 3.512, 345), ("2", 2, 17, 3.525, 345), ("3", 15, 4, 1.986, 500), ("4", 17, 16, 4.665, 345),
    ("5", 4, 5, 2.345, 500), ("6", 4, 5, 2.345, 500), ("7", 5, 6, 2.975, 500), ("8", 5, 11, INF, 500),
    ("9", 6, 11, 1.444, 500), ("10", 4, 6, 4.666, 500), ("11", 15, 6, 2.924, 500), ("12", 15, 6, 2.924, 500),
    ("13", 11, 12, 2.324, 500), ("14", 16, 20, 4.049, 345), ("15", 17, 20, 6.940, 345),
]
# Transformers (name, type, W1, bus 1, W2, bus 2).
TRANSFORMERS = [
    ("T1", "GSU w/ GIC BD", 0.1, 2, INF, 1), ("T2", "GY-GY-D", 0.2, 4, 0.1, 3), ("T3", "GSU", 0.1, 17, INF, 18),
    ("T4", "GSU", 0.1, 17, INF, 19), ("T5", "Auto", 0.04, 15, 0.06, 16), ("T6", "GSU", 0.15, 6, INF, 7),
    ("T7", "GSU", 0.15, 6, INF, 8), ("T8", "GY-GY", 0.04, 5, 0.06, 20), ("T9", "GY-GY", 0.04, 5, 0.06, 20),
    ("T10", "GSU", 0.1, 12, INF, 13), ("T11", "GSU", 0.1, 12, INF, 14), ("T12", "Auto", 0.04, 4, 0.06, 3),
    ("T13", "GY-GY-D", 0.2, 4, 0.1, 3), ("T14", "Auto", 0.04, 4, 0.06, 3), ("T15", "Auto", 0.04, 15, 0.06, 16),
]
# Substations (number, buses, grounding ohm, latitude, longitude).
SUBSTATIONS = [
    (1, [1, 2], INF, 33.6135, -87.3737), (2, [17, 18, 19], 0.2, 34.3104, -86.3658), (3, [15, 16], 0.2, 33.9551, -84.6794),
    (4, [3, 4], 1.0, 33.5479, -86.0746), (5, [5, 20], 0.1, 32.7051, -84.6634), (6, [6, 7, 8], 0.1, 33.3773, -82.6188),
    (7, [11], 0.1, 34.2522, -82.8363), (8, [12, 13, 14], 0.1, 34.1956, -81.098),
]
NO_NEUTRAL = 7  # a switching station without transformers
