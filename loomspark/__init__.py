"""Record analytics on PySpark: typed pipelines, dedupe, diffs, profiles and text tools."""
