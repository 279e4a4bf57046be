"""Spark-first structural analytics over fact tables, edge tables and text."""
