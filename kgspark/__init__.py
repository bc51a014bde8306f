"""Corpus and knowledge-graph jobs expressed as Spark DataFrame programs."""
