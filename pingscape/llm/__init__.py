"""Operators on text, vectors and conversations for training-data pipelines; nothing else in the library imports them."""
