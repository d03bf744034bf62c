"""Readers and writers of the survey files."""
