"""Execution plans: normalising and comparing."""
