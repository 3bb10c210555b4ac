"""Sieveline: dataset auditing, leakage-free evaluation and corpus preparation on Spark."""
