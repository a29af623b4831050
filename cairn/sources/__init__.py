"""Readers and writers of the feature, register and report formats."""
