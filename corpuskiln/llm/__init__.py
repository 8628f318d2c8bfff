"""Operators that prepare text collections for training and retrieval models."""
