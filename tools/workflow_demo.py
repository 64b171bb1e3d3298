"""End-to-end use of the library on the ``dirty_orders`` view of a test-data
folder: register -> audit -> notes -> prepare -> EDA -> plan -> compare models
-> evaluation tables -> artifacts.

Usage: python tools/workflow_demo.py [sf_dir] [catalog_root]
"""

from __future__ import annotations

import sys
import tempfile

sys.path.insert(0, ".")

from tablewright import get_spark  # noqa: E402
from tablewright.ml.compare import train_and_compare  # noqa: E402
from tablewright.operators import evaluation as V  # noqa: E402
from tablewright.operators.audit import audit_dataset  # noqa: E402
from tablewright.operators.planning import detect_task, feature_presets, recommend_transform  # noqa: E402
from tablewright.plans.eda_select import run_eda  # noqa: E402
from tablewright.plans.prep import PrepOptions, fit_preparation, preparation_notes  # noqa: E402
from tablewright.sources.catalog import Catalog  # noqa: E402
from tablewright.sources.tables import dirty_orders  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    root = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="tw-demo-")
    spark = get_spark("local[8]", 8)
    cat = Catalog(spark, root)
    ds = cat.save_dataset(dirty_orders(spark, sf), "dirty_orders.csv")
    raw = cat.load_dataset(ds)
    cat.dataset_listing().show(truncate=False)

    audit = audit_dataset(raw)
    for name, t in audit.items():
        print(name)
        t.show(truncate=False)
    preparation_notes(audit).show(truncate=False)

    plan = fit_preparation(raw, PrepOptions(max_missing_pct=50.0, clip_outliers=True))
    df = plan.transform(raw)
    for change, value in plan.summary_rows():
        print(f"{change:30s} {value}")

    target = "amount"
    tables = run_eda(df, target, options={"order_by": ["o_orderkey"]})
    print("EDA tables:", ", ".join(f"{k} ({v.count()} rows)" for k, v in tables.items()))

    task = detect_task(df, target)
    transform = recommend_transform(df, target, task)
    presets = feature_presets(df, target, task)
    features = presets.get("Top Correlated") or presets["All Features"]
    print("task", task, "transform", transform, "features", features)

    art = train_and_compare(df, target, task, feature_columns=features, target_transform=transform,
                            key_cols=["o_orderkey"], model_names=["Linear Regression", "Ridge", "Lasso"])
    art.leaderboard.show()
    art.setup.show(truncate=False)
    art.evaluation.show()
    V.error_bands(art.test_predictions, "actual", "predicted").show()
    V.residual_hist(art.test_predictions, "actual", "predicted", 30).show(5)
    print(cat.persist_training_artifacts(art, ds))
    print("missing artifacts:", cat.missing_artifacts(ds))


if __name__ == "__main__":
    main()
