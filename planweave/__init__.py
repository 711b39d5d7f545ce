"""Project-coordination analytics as PySpark DataFrame jobs."""
