"""Prompts as they arrive."""
