"""Vector search and analytics as Spark plans."""
