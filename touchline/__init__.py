"""PySpark analytics for league and post data, and for large text corpora."""
