"""Shared plan building blocks: ordering, exact percentiles, shared storage."""
