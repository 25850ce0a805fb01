"""Analytics for scenes observed in part, and corpus preparation, as PySpark plans."""
