"""Operators for preparing text corpora at scale: one module for each operator."""
