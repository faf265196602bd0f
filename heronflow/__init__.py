"""Network-telemetry analytics as PySpark DataFrame transformations."""
