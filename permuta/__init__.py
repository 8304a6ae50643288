"""permuta: a PySpark engine for ranked data."""
