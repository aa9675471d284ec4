"""Quillon: evidence analytics over document corpora, expressed as Spark plans."""
