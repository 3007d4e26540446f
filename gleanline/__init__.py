"""Posting intelligence on Spark: normalise, resolve, filter, rank, score, track and report."""
