"""A fact-memory analytics engine on PySpark."""
