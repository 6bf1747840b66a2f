"""Evidence and calibration analytics on Spark."""
