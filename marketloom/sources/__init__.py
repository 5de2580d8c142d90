"""Readers, normalisers and the Parquet table store."""
