"""Operators of a training-data pipeline over the tables of documents, labels and benchmark items."""
