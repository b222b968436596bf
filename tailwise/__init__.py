"""Distribution-free analytics on Spark, built on partial moments."""

__version__ = "0.1.0"
