"""Run the chosen EDA modules of a table: {module: result DataFrame}.  A module
that the table gives no input for, or that is asked for an unknown column,
answers with a note: one row, column ``note``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import eda as E
from tablewright.operators.corr import corr_matrix
from tablewright.operators.planning import detect_task
from tablewright.operators.profile import dataset_kpis
from tablewright.schema import categorical_cols, numeric_cols

# Module names, in order; the first seven are the default.
MODULES = [
    "Data Quality Summary", "Missingness", "Numeric Distributions", "Outlier Boxplots",
    "Categorical Distributions", "Correlation Heatmap", "Pairwise Relationships",
    "Target Deep Dive", "Custom Feature Plot",
]
DEFAULT_OPTIONS: dict[str, Any] = {"top_missing": 12, "max_numeric": 6, "bins": 30, "max_categories": 15,
                                   "corr_method": "pearson", "sample_rows": 1000, "viz_x": None,
                                   "viz_y": None, "viz_plot_type": "scatter", "order_by": None,
                                   "report": False, "max_fliers": 50}
# Fixed value: a written report shows at most this many categorical columns.
REPORT_MAX_CATEGORICAL = 4

#: What a module needs of the numeric and categorical columns, and what it says without.
NEEDS = {
    "Numeric Distributions": (lambda num, cat: num, "The table has no numeric column."),
    "Outlier Boxplots": (lambda num, cat: num, "The table has no numeric column."),
    "Categorical Distributions": (lambda num, cat: cat, "The table has no categorical column."),
    "Correlation Heatmap": (lambda num, cat: len(num) >= 2, "A correlation needs two numeric columns."),
    "Pairwise Relationships": (lambda num, cat: len(num) >= 2, "Pairs need two numeric columns."),
}


def run_eda(df: DataFrame, target: str | None, modules: list[str] | None = None,
            options: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    mods = modules or MODULES[:7]
    o = {**DEFAULT_OPTIONS, **(options or {})}
    num = numeric_cols(df)
    cat = categorical_cols(df)
    order_by = o["order_by"] or list(df.columns)
    out: dict[str, DataFrame] = {}

    def note(m: str, text: str) -> None:
        out[m] = df.sparkSession.createDataFrame([(text,)], "note string")

    for m in mods:
        if m not in MODULES:
            raise ValueError(f"unknown module {m}; known: {', '.join(MODULES)}")
        if m in NEEDS and not NEEDS[m][0](num, cat):
            note(m, NEEDS[m][1])
            continue
        if m == "Data Quality Summary":
            out[m] = E.quality(df)
            out[m + " (totals)"] = dataset_kpis(df, target)
        elif m == "Missingness":
            out[m] = E.missingness(df, int(o["top_missing"]))
        elif m == "Numeric Distributions":
            out[m] = E.histograms(df, num[:int(o["max_numeric"])], int(o["bins"]))
        elif m == "Outlier Boxplots":
            out[m] = E.boxplot(df, num[:int(o["max_numeric"])])
            out[m + " (fliers)"] = E.flier_sample(df, out[m], int(o["max_fliers"]))
        elif m == "Categorical Distributions":
            k = max(2, int(o["max_numeric"]) // 2)
            if o["report"]:
                k = min(k, REPORT_MAX_CATEGORICAL)
            out[m] = E.categories(df, k, int(o["max_categories"]))
        elif m == "Correlation Heatmap":
            out[m] = corr_matrix(df, num, str(o["corr_method"]))
        elif m == "Pairwise Relationships":
            cols = num[:min(int(o["max_numeric"]), 6)]
            sample = E.head_sample(df, cols, int(o["sample_rows"]), order_by)
            out[m] = sample
            # diagonal of the scatter matrix: histograms of the same sample
            out[m + " (diagonal)"] = E.histograms(sample, cols, 10)
        elif m == "Target Deep Dive":
            if target not in df.columns:
                note(m, f"No column {target} in this table." if target else "No target column was chosen.")
                continue
            if detect_task(df, target) == "classification":
                out[m] = E.value_counts(df, [target])
            else:
                out[m] = E.histograms(df, [target], 25)
            feats = [c for c in num if c != target][:max(2, int(o["max_numeric"]) // 2)]
            if feats and target in num:
                # every row, as 2-D binned counts per (feature, target)
                out[m + " (scatter)"] = E.target_scatter_bins(df, target, feats, 50)
        elif m == "Custom Feature Plot":
            if not df.columns:
                note(m, "The table has no columns.")
                continue
            x = o["viz_x"] if o["viz_x"] in df.columns else df.columns[0]
            y = o["viz_y"]
            if not y or y == "<none>":
                out[m] = E.top_values(df, [x], 20)
            elif y not in df.columns:
                note(m, f"No column {y} in this table.")
            else:
                sample = E.head_sample(df, [x, y], 2000, order_by)
                if o["viz_plot_type"] == "bar":
                    out[m] = E.group_mean(sample, x, y).orderBy(F.asc_nulls_last("x")).limit(30)
                else:
                    out[m] = sample.select(x, y)
    return out
