"""Behaviour analytics on Spark: traces and texts in, features, distances and scores out."""
