"""Readers of annotation, alignment, matrix and result files."""
