"""Operators for building a training corpus: one module per operator."""
