"""Composite audits: several operators in one plan."""
