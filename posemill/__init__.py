"""Screening analytics as Spark plans: scored poses, variants and molecules at cluster scale."""
