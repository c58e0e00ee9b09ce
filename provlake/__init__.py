"""provlake: citation provenance and evidence verification on Spark DataFrames."""

__version__ = "0.1.0"
