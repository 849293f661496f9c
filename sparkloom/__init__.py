"""Corpus and trajectory analytics as Spark DataFrame plans."""
