"""Cohort analytics on Spark: longitudinal admissions, measurements and drug administrations."""
