"""ferrule: analytics over job postings, application trackers and text collections, on PySpark DataFrames."""

__version__ = "0.1.0"
