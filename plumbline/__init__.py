"""Data validation and reconciliation expressed as Spark DataFrame plans."""
