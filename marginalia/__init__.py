"""Marginalia: notes, vectors and vault changelogs as Spark DataFrame jobs."""
