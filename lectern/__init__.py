"""Spark-first curation of question-answer corpora."""
