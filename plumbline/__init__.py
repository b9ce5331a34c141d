"""PL/SQL code analytics on Spark."""
