"""Readers and generators of points, workloads and logs."""
