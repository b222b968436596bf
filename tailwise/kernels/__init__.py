"""NumPy kernels for one group at a time; no Spark here."""
