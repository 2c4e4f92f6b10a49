"""Partita: a PySpark-native analytics engine for symbolic-music and token corpora."""
