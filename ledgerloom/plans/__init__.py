"""Compositions of operators: the manual, grouped and evidence-based pipelines."""
