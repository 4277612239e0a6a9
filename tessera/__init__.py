"""Tessera: a PySpark-native engine for curating and querying text corpora."""
