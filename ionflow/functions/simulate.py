"""Predicted y-ion intensities from a log-linear model of neighbouring cuts.

The peak of the longest y ion has a given height; each next cut's height is the last one's times
exp(bias + residue terms around the cut + counts of K and R on both sides + distances to both
ends). The coefficients are the user's: a table (term, key, weight) with the terms ``bias``,
``residue`` (key ``offset:letter``), ``kr_left``, ``kr_right`` (key: count), ``n_distance`` and
``c_distance`` (key: residues). Only doubly charged peptides have predictions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.functions.kernels import ISOTOPES, isotope_pattern
from ionflow.functions.peptides import ENDS, RESIDUES, H

Model = dict[tuple[str, str], float]


def model_of(table: DataFrame) -> Model:
    """A coefficient table holds a few hundred rows."""
    return {(r["term"], str(r["key"])): r["weight"] for r in table.limit(100_000).collect()}


def log_ratio(sequence: str, cut: int, model: Model, reach: int = 4) -> float:
    """Log of the height after the cut before residue ``cut`` over the one before it."""
    total = model.get(("bias", ""), 0.0)
    for offset in range(-reach, reach):
        if 0 <= cut + offset < len(sequence):
            total += model.get(("residue", f"{offset}:{sequence[cut + offset]}"), 0.0)
    kr = [c in "KR" for c in sequence]
    for term, key in (("kr_left", sum(kr[:cut])), ("kr_right", sum(kr[cut:])), ("n_distance", cut), ("c_distance", len(sequence) - cut)):
        total += model.get((term, str(key)), 0.0)
    return total


def y_ions(sequence: str, model: Model, start: float = 10_000.0, isotopes: int = 1) -> list[dict]:
    """cut_info, m/z at charge one and intensity of y(n-1) to y1; with ``isotopes`` further peaks by their natural ratio."""
    out, height, n = [], start, len(sequence)
    masses = np.cumsum([RESIDUES.get(c, 0.0) for c in reversed(sequence)])
    for i in range(n - 1, 0, -1):
        shown = 0.0 if (i == n - 1 and n >= 20) or (i == n - 2 and n > 22) else height
        mz = float(masses[i - 1] + ENDS["y"] + H)
        pattern = isotope_pattern(mz)
        out += [{"cut_info": f"y{i}", "mz": round(mz + k, 4), "intensity": shown * float(pattern[k] / pattern[0]), "charge": 1} for k in range(min(isotopes, ISOTOPES))]
        height *= math.exp(log_ratio(sequence, n - i, model))
    return out


def predict(df: DataFrame, sequence: str, charge: str, model: Model, top: int | None = None, isotopes: int = 1) -> DataFrame:
    """``df`` with ``predicted``: fragments by falling intensity, the ``top`` ones if given; null for charges other than two."""
    kind = "array<struct<cut_info:string,mz:double,intensity:double,charge:int>>"

    @F.pandas_udf(kind)
    def run(s, z):
        import pandas as pd

        made = [sorted(y_ions(a, model, isotopes=isotopes), key=lambda f: (-f["intensity"], f["mz"]))[:top] if a and b == 2 else None for a, b in zip(s, z, strict=True)]
        return pd.Series(made)

    return df.withColumn("predicted", run(F.col(sequence), F.col(charge)))
