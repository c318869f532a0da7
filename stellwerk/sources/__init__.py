"""Readers and writers: landing zone, lake layers, visit log, run status."""
