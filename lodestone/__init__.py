"""Lodestone: matching free-text requirements against a document corpus, as PySpark DataFrame operators."""
