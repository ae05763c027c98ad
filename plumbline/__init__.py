"""Plumbline: validation of tables, texts and predictions as Spark plans."""
