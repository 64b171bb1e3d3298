"""Model catalogue: three classifiers and five regressors as Spark ML
estimators with the reference's hyper-parameters translated to Spark's
objective functions (see README for the derivations)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

# Model names and hyper-parameters of the comparison.
CLASSIFIERS = ["Logistic Regression", "Random Forest", "Gradient Boosting"]
REGRESSORS = ["Linear Regression", "Ridge", "Lasso", "Random Forest", "Gradient Boosting"]
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 0.001
LASSO_MAX_ITER = 5000
LOGREG_C = 1.0
LOGREG_MAX_ITER = 1000
FOREST_TREES = 300
BOOST_STAGES = 100
BOOST_DEPTH = 3
BOOST_RATE = 0.1
SEED = 42
# Spark trees are depth-bounded (<= 30); unlimited depth is not available.
FOREST_MAX_DEPTH = 30
NORMAL_SOLVER_MAX_FEATURES = 4096
# Tree training: more nodes per data pass and cached node ids (same trees,
# fewer passes); with a checkpoint dir set, node-id lineage is cut every 10 iterations.
TREE_OPTS = dict(maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
# Shallow boosted trees gain nothing from cached node ids (measured slower).
BOOST_OPTS = dict(maxMemoryInMB=1024, checkpointInterval=10)


@dataclass
class FoldStats:
    """Training-part figures some objectives are scaled by."""
    n: int
    label_sd_pop: float = 0.0
    n_classes: int = 2
    n_features: int = 0


def classifier(name: str, st: FoldStats, label="_label", features="features"):
    common = dict(labelCol=label, featuresCol=features)
    if name == "Logistic Regression":
        # sklearn: 0.5||w||^2 + C * sum(loss)  ==  Spark: mean(loss) + regParam/2 ||w||^2
        return LogisticRegression(regParam=1.0 / (LOGREG_C * max(st.n, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=LOGREG_MAX_ITER, tol=1e-6, **common)
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=FOREST_TREES, featureSubsetStrategy="sqrt", seed=SEED,
                                      maxDepth=FOREST_MAX_DEPTH, minInstancesPerNode=1, **TREE_OPTS, **common)
    if name == "Gradient Boosting":
        gbt = GBTClassifier(maxIter=BOOST_STAGES, maxDepth=BOOST_DEPTH, stepSize=BOOST_RATE, seed=SEED,
                            **BOOST_OPTS, **common)
        if st.n_classes > 2:
            return OneVsRest(classifier=gbt, parallelism=min(st.n_classes, 4), **common)
        return gbt
    raise ValueError(name)


def regressor(name: str, st: FoldStats, label="_label", features="features"):
    common = dict(labelCol=label, featuresCol=features)
    solver = "normal" if st.n_features <= NORMAL_SOLVER_MAX_FEATURES else "l-bfgs"
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0, solver=solver, **common)
    if name == "Ridge":
        # Spark scales the label internally; alpha maps to alpha * sd(y) / n
        return LinearRegression(regParam=RIDGE_ALPHA * st.label_sd_pop / max(st.n, 1), elasticNetParam=0.0,
                                standardization=False, solver=solver, **common)
    if name == "Lasso":
        return LinearRegression(regParam=LASSO_ALPHA, elasticNetParam=1.0, standardization=False,
                                maxIter=LASSO_MAX_ITER, tol=1e-6, **common)
    if name == "Random Forest":
        return RandomForestRegressor(numTrees=FOREST_TREES, featureSubsetStrategy="all", seed=SEED,
                                     maxDepth=FOREST_MAX_DEPTH, minInstancesPerNode=1, **TREE_OPTS, **common)
    if name == "Gradient Boosting":
        return GBTRegressor(maxIter=BOOST_STAGES, maxDepth=BOOST_DEPTH, stepSize=BOOST_RATE, seed=SEED,
                            **BOOST_OPTS, **common)
    raise ValueError(name)
