"""foliospark: corpus building and analysis for article and note collections on PySpark."""
