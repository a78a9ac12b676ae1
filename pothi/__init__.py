"""Corpus processing, retrieval and reading views as Spark DataFrame operators."""
