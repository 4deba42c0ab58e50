"""Matching, deduplication and text operators for training data; nothing outside this folder imports it."""
