"""Whole plans composed of operators: the scoring run and the read model."""
