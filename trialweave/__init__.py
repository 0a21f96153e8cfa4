"""Cohort analytics on Spark: registry cleaning, cohort splits, models, evaluation and image features."""
