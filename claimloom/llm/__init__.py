"""Operators for preparing training data at scale, and their queries."""
