"""Operators: predicates, histograms, hits, merging, time index, many requests."""
