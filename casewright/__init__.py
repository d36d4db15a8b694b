"""Onboarding-compliance analytics as plain PySpark DataFrame jobs."""
