"""Text for reports: numbers with a fixed count of digits, rounded by their exact binary value.

The built-in formatter rounds the shortest decimal form, so 9.95 (stored a little below)
would print as 10.0 instead of 9.9. Only report tables of a few rows are formatted this way.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def _fixed(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(values, digits)],
                     dtype="object")


def text(template: str, *args: str | Column) -> Column:
    """``format_string`` whose %.Nf places are rounded exactly."""
    cols = [F.col(a) if isinstance(a, str) else a for a in args]
    places = re.findall(r"%%|%,?d|%s|%\.\df", template)
    at = 0
    for place in places:
        if place == "%%":
            continue
        if place.endswith("f"):
            cols[at] = _fixed(cols[at].cast("double"), F.lit(int(place[2])))
        at += 1
    return F.format_string(re.sub(r"%\.\df", "%s", template), *cols)
