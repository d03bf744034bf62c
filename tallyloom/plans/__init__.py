"""Presets and shared plan helpers."""
