"""Spark ML side: feature pipeline, split and folds, model comparison."""
