"""orbitspark: analytics over irregular per-object tracking series, as PySpark DataFrame stages."""
