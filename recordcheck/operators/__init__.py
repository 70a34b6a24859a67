"""Matching, scoring, evaluation, review and patching over DataFrames."""
