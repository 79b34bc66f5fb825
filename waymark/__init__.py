"""waymark: geocoding and text-spatial search as PySpark DataFrame operators."""
