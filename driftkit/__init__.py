"""Table comparison, schema drift and migration checks as Spark DataFrame jobs."""

__version__ = "0.1.0"
