"""Annotation coverage, prompting, merging and diffing of text corpora on Spark."""
