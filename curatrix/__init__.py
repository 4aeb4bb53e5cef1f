"""Curatrix: bibliographic metadata curation and corpus preparation on Spark."""
