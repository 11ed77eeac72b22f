"""PySpark operators for a temporal memory graph over activity streams."""
