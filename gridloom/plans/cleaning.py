"""The documented cleaning sequence of a whole table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import clean
from ..operators.diagnose import iqr_bounds
from ..operators.filters import sanitize_missing
from ..operators.profile import convertible_text
from ..operators.roles import model_roles, present_columns, trim_names
from ..session import checkpointed


@dataclass
class CleaningSummary:
    steps: list[str] = field(default_factory=list)
    imputation: dict[str, str] = field(default_factory=dict)
    dropped_duplicates: int = 0
    dropped_constant: list[str] = field(default_factory=list)
    dropped_sparse: list[str] = field(default_factory=list)
    outlier_capped: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple[str, str]]:
        return (
            [("step", s) for s in self.steps]
            + [(f"imputation_{k}", v) for k, v in self.imputation.items()]
            + [("dropped_duplicates", str(self.dropped_duplicates))]
            + [("dropped_constant", c) for c in self.dropped_constant]
            + [("dropped_sparse", c) for c in self.dropped_sparse]
            + [("outlier_capped", c) for c in self.outlier_capped]
            + [("note", n) for n in self.notes]
        )

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "entry string, value string")


def clean_dataset(df: DataFrame, numeric, categorical, coercions: dict | None = None, indicators: bool = True,
                  strategy: str = "median", fill: str = clean.FILL_TEXT, reach: float = 1.5,
                  max_top_share: float = clean.MAX_TOP_SHARE, key: str | None = None):
    """Coerce, flag, impute, cap, deduplicate, drop uninformative columns: ``(DataFrame, CleaningSummary)``.

    Up to the deduplication every step is narrow, so its statistics passes rescan pruned columns
    instead of caching rows. The deduplicated rows are materialized once in the shared folder.
    """
    report = CleaningSummary()
    df = trim_names(df)
    numeric, lost_numbers = present_columns(df, [c.strip() for c in numeric])
    categorical, lost_text = present_columns(df, [c.strip() for c in categorical])
    if lost_numbers or lost_text:
        report.notes.append(f"columns not found, skipped: numeric={lost_numbers}, categorical={lost_text}")

    df = clean.coerce(df, **(coercions or {}))
    report.steps.append("type_coercion")
    if indicators:
        df = clean.add_missing_indicators(df, numeric + categorical)
        report.steps.append("missing_indicator_added")

    if strategy == "knn":
        if key is None:
            raise ValueError("strategy 'knn' needs key, the column that names a row")
        df = clean.impute_neighbors(df, numeric, key)
    else:
        df = clean.impute(df, numeric, strategy)
    df = clean.fill_text(df, categorical, fill)
    report.steps.append("imputation")
    report.imputation = {"numeric": strategy, "categorical": f"mode/{fill}"}

    bounds = iqr_bounds(df, numeric, reach)
    df = clean.cap_to(df, bounds)
    report.steps.append("outlier_cap")
    report.outlier_capped = list(bounds)

    before = df.count()
    df = checkpointed(clean.drop_duplicates(df))
    report.dropped_duplicates = before - df.count()
    if report.dropped_duplicates:
        report.steps.append("drop_duplicates")

    report.dropped_constant = clean.constant_columns(df)
    df = clean.drop_columns(df, report.dropped_constant)
    if report.dropped_constant:
        report.steps.append("drop_constant")
    report.dropped_sparse = clean.sparse_columns(df, max_top_share=max_top_share)
    df = clean.drop_columns(df, report.dropped_sparse)
    if report.dropped_sparse:
        report.steps.append("drop_sparse")
    return df, report


def auto_clean(df: DataFrame, max_top_share: float = 0.9):
    """Clean with inferred column roles; text that is mostly numbers becomes numeric first."""
    df = sanitize_missing(df)
    roles = model_roles(df)
    convertible = []
    if roles.categorical:
        found = convertible_text(df, roles.categorical).where("convertible").select("column").collect()
        names = {r["column"] for r in found}
        convertible = [c for c in roles.categorical if c in names]
    return clean_dataset(
        df, roles.numeric + convertible, [c for c in roles.categorical if c not in convertible],
        coercions={"to_numeric": [c.strip() for c in convertible]}, max_top_share=max_top_share,
    )
