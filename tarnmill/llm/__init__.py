"""Operators for pipelines that prepare training data. Nothing outside this folder imports it."""
