"""Extra: keyed aggregation over unbounded input."""
