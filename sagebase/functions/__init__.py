"""Part of the knowledge-base engine."""
