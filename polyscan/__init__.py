"""Federated analytics on Spark: heterogeneous sources as typed SQL tables."""
