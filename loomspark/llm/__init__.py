"""Operators for training text: vectors, personal data, clusters, tokens, leaks, look-alikes."""
