"""lakemill: a PostgreSQL-flavoured analytics layer that plans and runs on Spark."""

__version__ = "0.1.0"
