"""Readers of cohort files and writers of results."""
