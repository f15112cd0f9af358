"""Log anomaly detection and classification as PySpark DataFrame jobs."""
