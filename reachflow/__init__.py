"""Dependency-closure analytics on Spark: reachability, choices, spans and diffs over typed graphs."""
