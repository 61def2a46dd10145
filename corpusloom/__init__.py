"""Corpus analytics on PySpark: building, cleaning and evaluating multilingual text corpora."""
