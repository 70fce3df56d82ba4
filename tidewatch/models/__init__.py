"""Distributed outlier models."""
