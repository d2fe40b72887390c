"""Space-weather risk to power grids as PySpark DataFrame operators."""
