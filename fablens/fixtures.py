"""A seeded wafer table with the seven planted relations, and its negative control. Effect sizes are this library's choice."""

from __future__ import annotations

import numpy as np
import pandas as pd

NOMINAL = {"PHEMT_0.15um": 0.15, "PHEMT_0.25um": 0.25, "PHEMT_0.35um": 0.35}
PLANTED = ["GATE2_CD_Gate_Leg_Length", "TOPSIN_ET_Load_Pull_P.A.E_Last", "TOPSIN_ET_DC_PIV_Drain_Lag_1", "SIN_Thickness_SiN_Thickness", "OHMIC_ET_Rc_an_ct2", "OHMIC_ET_Rsh_an_ct2", "GATE2_Ali_Litho_Gate_to_recess_alignment", "Delta_Gm"]
LEAKAGE = ["Actual Sorting Yield (%)", "LineYield", "BackEndYield", "VIYield", "LTYield", "TotalYield"]


def planted(n: int = 1500, noise_columns: int = 40, effect: float = 1.0, seed: int = 11) -> pd.DataFrame:
    """effect 0 gives the negative control."""
    r = np.random.default_rng(seed)
    tech = r.choice(list(NOMINAL), n)
    nominal = np.vectorize(NOMINAL.get)(tech)
    t = {
        "LotName": [f"L{i // 25}" for i in range(n)],
        "WaferNum": np.arange(n) % 25,
        "Process": "P1",
        "Exception": np.where(np.arange(n) < 5, "x", "none"),
        "Technology": tech,
        "GATE2_CD_Gate_Leg_Length": nominal + r.normal(0, 0.01, n),
        "TOPSIN_ET_Load_Pull_P.A.E_Last": r.normal(50, 5, n),
        "TOPSIN_ET_DC_PIV_Drain_Lag_1": r.uniform(0, 12, n),
        "SIN_Thickness_SiN_Thickness": r.normal(0.150, 0.004, n),
        "OHMIC_ET_Rc_an_ct2": r.normal(0, 1, n),
        "OHMIC_ET_Rsh_an_ct2": r.normal(0, 1, n),
        "GATE2_Ali_Litho_Gate_to_recess_alignment": r.normal(0, 1, n),
        "FIC_ET_Gm_max": r.normal(300, 10, n),
    }
    t["TOPSIN_ET_Gm_max"] = t["FIC_ET_Gm_max"] + r.normal(-5, 5, n)
    d_cd, d_sin = np.abs(t["GATE2_CD_Gate_Leg_Length"] - nominal), np.abs(t["SIN_Thickness_SiN_Thickness"] - 0.150)
    y = 90 + r.normal(0, 1, n)
    y += effect * (-200 * d_cd + 0.25 * (t["TOPSIN_ET_Load_Pull_P.A.E_Last"] - 50) - 1.5 * np.maximum(0, t["TOPSIN_ET_DC_PIV_Drain_Lag_1"] - 7) - 6e4 * d_cd * d_sin)
    y += effect * (-1.5 * np.maximum(0, t["OHMIC_ET_Rc_an_ct2"]) * np.maximum(0, t["OHMIC_ET_Rsh_an_ct2"]) - 1.5 * np.abs(t["GATE2_Ali_Litho_Gate_to_recess_alignment"]) + 0.3 * (t["TOPSIN_ET_Gm_max"] - t["FIC_ET_Gm_max"]))
    t["SortingYield"] = y
    t["Actual Sorting Yield (%)"] = y + r.normal(0, 0.1, n)
    for i in range(noise_columns):
        x = r.normal(0, 1, n)
        if i == 0:
            x[::10] = np.nan
        t[f"NOISE_{i}"] = np.round(x, 1) if i % 3 == 0 else x
    return pd.DataFrame(t)
