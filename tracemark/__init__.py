"""Media and claim forensics as PySpark DataFrame jobs."""
