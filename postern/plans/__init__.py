"""Predicates, their normalised plans, and the Spark columns that plans become."""
