"""Operators for building training data for language models."""
