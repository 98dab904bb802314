"""The adaptive preprocessing as a fitted plan that can be applied again to new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import CHUNK, aggregate_row, categorical_columns, numeric_columns, q
from ..operators import prep
from ..operators.neighbors import impute_knn
from ..session import cut_lineage

# Fixed values of the adaptive rules.
KNN_MIN_ROWS = 100
KNN_MIN_COLUMNS = 3
KNN_NEIGHBORS = 5
OUTLIER_MIN_ROWS = 100
VARIANCE_MIN_COLUMNS = 10
STANDARD_MIN_ROWS = 1000


@dataclass
class PreprocessModel:
    """Everything learned from the fitting table: O(columns * categories) values, plus the
    donor table when missing numbers are filled from neighbours."""
    key: str
    numeric: list[str]
    categorical: list[str]
    dropped: dict[str, float]
    imputer: str
    fill: dict[str, float | None]
    donors: DataFrame | None
    modes: dict[str, str]
    bounds: dict[str, tuple[float, float]]
    outliers: str
    scaler: str
    scale: dict[str, tuple[float, float]]
    encodings: dict[str, tuple[int, list[str] | None]]
    hash_method: str
    steps: list[str] = field(default_factory=list)
    insights: list[tuple[str, str, str]] = field(default_factory=list)
    summary: dict = field(default_factory=dict)
    fitted_table: DataFrame | None = None
    low_variance: list[str] = field(default_factory=list)

    def fill_missing(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        cols = self.numeric + self.low_variance
        df = df.select(*[q(c) for c in df.columns if c not in self.dropped])
        if self.imputer == "drop":
            df = prep.drop_missing_rows(df)
        elif self.imputer == "knn" and cols:
            df = impute_knn(df, self.key, cols, KNN_NEIGHBORS, None if fitting else self.donors)
        elif cols:
            df = prep.impute_median(df, cols, self.fill)
        if self.modes:
            df = prep.replace(df, {c: F.coalesce(q(c).cast("string"), F.lit(self.modes.get(c)))
                                   for c in self.categorical})
        return prep.impute_categorical(df, self.categorical)

    def finish(self, df: DataFrame) -> DataFrame:
        """Outliers, scaling and encoding of a filled table: one projection, no shuffle."""
        if self.outliers == "cap":
            df = prep.iqr_cap(df, list(self.bounds), self.bounds)
        elif self.outliers == "remove":
            df = prep.iqr_filter(df, list(self.bounds), self.bounds)
        out = [q(self.key)]
        out += [(prep.scaled(c, *self.scale[c]) if c in self.scale else q(c)).alias(c)
                for c in self.numeric]
        for c in self.categorical:
            values = self.encodings[c][1]
            if values is None:
                out.append(prep.hash_bucket(q(c), self.hash_method).alias(f"{c}_hash"))
            else:
                out += prep.one_hot_columns(c, values)
        return df.select(*out)

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the fitted plan to rows with the fitted columns; keys must be new."""
        return self.finish(self.fill_missing(df))

    def features(self, include_encoded: bool = False) -> list[str]:
        """Columns for later analysis; hashed categories are unscaled and left out by default."""
        cols = list(self.numeric)
        if include_encoded:
            cols += [f"{c}_hash" for c in self.categorical if self.encodings[c][1] is None]
        return cols


class AdaptivePreprocessor:
    """Impute, deduplicate, treat outliers, drop flat columns, scale, encode.

    ``imputer``  auto | knn | median | mode | drop     (auto: knn above 100 rows and 3 columns)
    ``outliers`` auto | cap | remove | zscore | none   (auto: cap above 100 rows)
    ``scaler``   auto | standard | robust | minmax | none  (auto: standard above 1000 rows)
    """

    def __init__(self, key: str, imputer: str = "auto", outliers: str = "auto",
                 scaler: str = "auto", hash_method: str = "md5",
                 features: Sequence[str] | None = None):
        for name, value, allowed in (
                ("imputer", imputer, ("auto", "knn", "median", "mode", "drop")),
                ("outliers", outliers, ("auto", "cap", "remove", "zscore", "none")),
                ("scaler", scaler, ("auto", "standard", "robust", "minmax", "none"))):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        self.key, self.imputer, self.outliers = key, imputer, outliers
        self.scaler, self.hash_method, self.only = scaler, hash_method, features

    def fit(self, df: DataFrame) -> PreprocessModel:
        key = self.key
        if self.only is not None:
            df = df.select(q(key), *[q(c) for c in self.only])
        numeric = numeric_columns(df, exclude=[key])
        categorical = categorical_columns(df, exclude=[key])
        cols = numeric + categorical
        # one pass: null counts of every column and the row count
        nulls = aggregate_row(df, cols, {"n": F.count, "all": lambda c: F.count("*")})
        rows = nulls[cols[0]]["all"] if cols else df.count()
        missing = {c: (1.0 - nulls[c]["n"] / rows if rows else 0.0) for c in cols}
        dropped = {c: missing[c] for c in numeric if missing[c] >= prep.HIGH_MISSING}
        handled = sum(rows - nulls[c]["n"] for c in cols if c not in dropped)
        numeric = [c for c in numeric if c not in dropped]

        imputer = self.imputer
        if imputer == "auto":
            imputer = "knn" if rows > KNN_MIN_ROWS and len(numeric) > KNN_MIN_COLUMNS else "median"
        gaps = [c for c in numeric if missing[c] > 0]
        if imputer == "knn" and not gaps:
            fill = {c: None for c in numeric}
            effective = "median"          # nothing to fill: keep the table as it is
        else:
            effective = imputer
            fill = {c: None for c in numeric}
            if imputer in ("median", "mode"):
                fill.update(prep.medians(df, gaps))
        modes = prep.modes(df, [c for c in categorical if missing[c] > 0]) \
            if imputer == "mode" and any(missing[c] > 0 for c in categorical) else {}

        model = PreprocessModel(
            key=key, numeric=numeric, categorical=categorical, dropped=dropped,
            imputer=effective, fill=fill, donors=df if effective == "knn" else None, modes=modes,
            bounds={}, outliers="none", scaler="none", scale={}, encodings={},
            hash_method=self.hash_method)
        log, notes = model.steps, model.insights
        for c, share in dropped.items():
            log.append(f"Removed numeric column '{c}' (missing: {share:.1%})")
            notes.append(("preprocessing",
                          f"Removed column '{c}' due to high missing values ({share:.1%})", "warning"))
        if numeric:
            name = {"knn": "KNN imputation", "drop": "Removal of incomplete rows"}.get(
                imputer, "Median imputation")
            log.append(f"{name} applied to {len(numeric)} numeric columns")
        for c in categorical:
            if missing[c] > 0 and imputer not in ("drop", "mode"):
                log.append(f"Missing values in '{c}' filled with '{prep.MISSING_LABEL}'")

        filled = model.fill_missing(df, fitting=True)
        before = rows if imputer != "drop" else filled.count()
        # written once: the passes below and the fitted table all read the deduplicated rows
        unique = cut_lineage(prep.dedupe_rows(filled, key))
        self._fit_unique(model, unique, before, log, notes)
        model.fitted_table = model.finish(unique)
        model.summary.update(
            columns_processed=len(model.fitted_table.columns) - 1,
            missing_values_handled=handled, numeric_features=len(model.numeric),
            preprocessing_steps=len(log))
        return model

    def _fit_unique(self, model: PreprocessModel, unique: DataFrame, before: int,
                    log: list[str], notes: list) -> None:
        n = unique.count()
        removed = before - n
        if removed > 0:
            log.append(f"Removed {removed} duplicate rows")
            notes.append(("preprocessing", f"Removed {removed} duplicate rows", "info"))

        numeric = model.numeric
        outliers = self.outliers
        if outliers == "auto":
            outliers = "cap" if n > OUTLIER_MIN_ROWS else "none"
        table = unique
        if numeric and outliers != "none":
            if outliers == "zscore":
                spread = prep.moments(unique, numeric)
                bounds = {c: (m - prep.ZSCORE_LIMIT * sd, m + prep.ZSCORE_LIMIT * sd)
                          for c, (m, sd) in spread.items()}
            else:
                bounds = prep.iqr_bounds(unique, numeric)
            hit = [c for c, k in prep.count_outside(unique, bounds).items() if k]
            model.bounds = {c: bounds[c] for c in hit}
            model.outliers = "cap" if outliers == "cap" else "remove"
            if hit:
                verb = "Capped" if outliers == "cap" else "Removed"
                method = "z-score" if outliers == "zscore" else "IQR"
                log.append(f"{verb} outliers in {len(hit)} columns")
                notes.append(("preprocessing",
                              f"{verb} outliers in {len(hit)} columns using {method} method", "info"))
            table = prep.iqr_cap(unique, hit, model.bounds) if outliers == "cap" \
                else prep.iqr_filter(unique, hit, model.bounds)
            if len(hit) > CHUNK:
                # hundreds of capped columns: written once, not planned again by each pass
                table = cut_lineage(table)

        if len(numeric) > VARIANCE_MIN_COLUMNS:
            low = prep.low_variance_columns(table, numeric)
            if low:
                model.low_variance = low
                model.numeric = numeric = [c for c in numeric if c not in low]
                text = f"Removed {len(low)} low-variance features"
                log.append(text)
                notes.append(("preprocessing", text, "info"))

        rows_left = n if outliers in ("cap", "none") else table.count()
        scaler = self.scaler
        if scaler == "auto":
            scaler = "standard" if rows_left > STANDARD_MIN_ROWS else "robust"
        if numeric and scaler != "none":
            learn = {"standard": prep.standard_parameters, "robust": prep.robust_parameters,
                     "minmax": prep.minmax_parameters}[scaler]
            model.scale = learn(table, numeric)
            name = {"standard": "StandardScaler", "robust": "RobustScaler",
                    "minmax": "MinMaxScaler"}[scaler]
            log.append(f"Applied {name} to {len(numeric)} numeric columns")
        model.scaler = scaler

        model.encodings = prep.categories(table, model.categorical)
        for c in model.categorical:
            size, values = model.encodings[c]
            if values is None:
                log.append(f"Hashed high-cardinality column '{c}' ({size} unique values)")
                notes.append(("preprocessing",
                              f"Applied hashing to high-cardinality column '{c}'", "info"))
            else:
                log.append(f"One-hot encoded column '{c}' ({size} categories)")
        model.summary.update(rows_processed=rows_left, duplicates_removed=removed)


def summary_row(model: PreprocessModel, spark) -> DataFrame:
    """(rows, columns, missing handled, duplicates removed, numeric features, steps)."""
    s = model.summary
    return spark.createDataFrame(
        [(s["rows_processed"], s["columns_processed"], s["missing_values_handled"],
          s["duplicates_removed"], s["numeric_features"], s["preprocessing_steps"])],
        "rows_processed long, columns_processed int, missing_values_handled long, "
        "duplicates_removed long, numeric_features int, preprocessing_steps int")
