"""Tables the results depend on, stated as they are."""

INF = float("inf")

# Line voltage (kV) -> standard class.
VOLTAGE_CLASS = {
    345: 345, 230: 230, 450: 500, 500: 500, 765: 765, 250: 230, 400: 345,
    232: 230, 1000: 765, 220: 230, 273: 230, 218: 230, 236: 230, 287: 345,
    238: 230, 200: 230, 167: 161, 169: 161, 161: 161,
}

# Line resistance in ohm per km by voltage (kV).
OHM_PER_KM = {
    765: 0.01, 500: 0.0141, 345: 0.0283, 232: 0.0450, 230: 0.0500,
    220: 0.0700, 161: 0.0800, 138: 0.0900, 69: 0.1200,
}

# Winding resistances (primary, secondary) in ohm by transformer type.
WINDING_OHM = {
    "GY-GY-D": (0.2, 0.1),
    "GY-GY": (0.04, 0.06),
    "Auto": (0.04, 0.06),
    "GSU": (0.15, INF),
    "GSU w/ GIC BD": (0.1, INF),
    "Tee": (0.01, 0.01),
    "GY-D": (0.05, INF),
}

# Substation type -> category.
SUBSTATION_CATEGORY = {
    "transmission": "transmission",
    "subtransmission": "transmission",
    "distribution": "distribution",
    "minor_distribution": "distribution",
    "industrial": "distribution",
    "transformer": "distribution",
    "generation": "generation",
    "generator": "generation",
    "collector": "generation",
    "switching": "switching",
    "switchyard": "switching",
    "converter": "switching",
    "compensation": "switching",
    "transition": "switching",
    "capacitor": "switching",
    "yes": "unknown",
    "TM": "unknown",
    "traction": "unknown",
}

# NAICS two-digit code -> economic sector.
NAICS_SECTOR = {
    "11": "AGR", "21": "MINING", "22": "UTIL_CONST", "23": "UTIL_CONST",
    "31": "MANUF", "32": "MANUF", "33": "MANUF",
    "42": "TRADE_TRANSP", "44": "TRADE_TRANSP", "48": "TRADE_TRANSP",
    "51": "INFO", "52": "FIRE", "53": "FIRE",
    "54": "PROF_OTHER", "55": "PROF_OTHER", "56": "PROF_OTHER", "81": "PROF_OTHER",
    "61": "EDUC_ENT", "62": "EDUC_ENT", "71": "EDUC_ENT", "72": "EDUC_ENT",
    "92": "G", "UNCLFD": "G",
}

# National-accounts code -> economic sector.
USE_TABLE_SECTOR = {
    "11": "AGR", "21": "MINING", "22": "UTIL_CONST", "23": "UTIL_CONST", "31G": "MANUF",
    "42": "TRADE_TRANSP", "44RT": "TRADE_TRANSP", "48TW": "TRADE_TRANSP", "51": "INFO",
    "FIRE": "FIRE", "PROF": "PROF_OTHER", "81": "PROF_OTHER", "6": "EDUC_ENT",
    "7": "EDUC_ENT", "G": "G",
}
USE_VALUE_ADDED_ROWS = ("V001", "V003", "T00OTOP", "T00OSUB")
USE_FINAL_DEMAND_COLUMNS = ("F010", "F100", "F020", "F030", "F040")
USE_OUTPUT_ROW = "T018"

SECTORS = (
    "AGR", "MINING", "UTIL_CONST", "MANUF", "TRADE_TRANSP",
    "INFO", "FIRE", "PROF_OTHER", "EDUC_ENT", "G",
)

# Ground-current column -> effective-current scenario name.
GROUND_SCENARIO = {
    "GIC_halloween": "e_halloween-year-hazard A/ph",
    "GIC_st_patricks": "e_st_patricks-year-hazard A/ph",
    "GIC_gannon": "e_gannon-year-hazard A/ph",
    "GIC_50": "e_50-year-hazard A/ph",
    "GIC_75": "e_75-year-hazard A/ph",
    "GIC_100": "e_100-year-hazard A/ph",
    "GIC_125": "e_125-year-hazard A/ph",
    "GIC_150": "e_150-year-hazard A/ph",
    "GIC_175": "e_175-year-hazard A/ph",
    "GIC_200": "e_200-year-hazard A/ph",
    "GIC_225": "e_225-year-hazard A/ph",
    "GIC_250": "e_250-year-hazard A/ph",
}

ALPHA_BETA_PERIODS = (75, 100, 125, 150, 175, 200, 225, 250)
ALPHA_BETA_LEVELS = ("conf_68_lower", "mean_prediction", "conf_68_upper")
RETURN_PERIODS = tuple(range(25, 251, 25))

# Tags kept from a map feature.
FEATURE_TAGS = (
    "name", "operator", "voltage", "power", "substation", "capacity", "frequency",
    "ref", "network", "operator:type", "owner", "start_date", "addr:state",
    "addr:city", "addr:county",
)

# Sites whose impedance bands are screened, and observatories left out.
SCREENED_EM_SITES = ("KSR32", "CAY09", "RER23")
LEFT_OUT_SITES = ("GUA", "HON")

# Failure-probability bins (percent) and ground-current classes (A).
FAILURE_BINS = (0, 10, 20, 40, 50, 75, 101)
GROUND_CLASSES = (0, 20, 40, 60, 80, 100, 200, 400)

# Perturbation parameters of the benchmark-grid variants.
VARIANT = {
    "p_block_500": 0.20, "p_block_345": 0.10, "hub_bump": 0.05, "blocked_ohm": 1e15,
    "p_keep2": 0.60, "p_keep1": 0.30, "p_keep0": 0.10, "p_bd_on": 0.35,
    "p_swap_delta": 0.30, "p_auto_to_wye": 0.15,
    "new_count": (1, 2, 3), "new_weights": (0.4, 0.4, 0.2),
    "p_site_block": 0.15, "rg_low": 0.1, "rg_high": 0.2,
}
