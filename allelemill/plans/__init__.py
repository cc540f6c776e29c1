"""Whole workloads: tables derived from the test data, and the registered queries with their SQL."""
