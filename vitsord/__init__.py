"""Vitsord: citation-first retrieval, answering, verification and evaluation as Spark DataFrame jobs."""
