"""Millrace: data preparation and evaluation analytics for language-model corpora on Spark."""
