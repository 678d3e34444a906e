"""Operators for preparing language-model training data, as Spark jobs. Nothing else in the package imports this folder."""
