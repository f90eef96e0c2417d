"""Operators for training data built around language models and their tokens."""
