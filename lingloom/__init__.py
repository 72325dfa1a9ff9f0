"""lingloom: parallel-text preparation and checking as PySpark DataFrame jobs."""
