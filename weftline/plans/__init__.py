"""Whole lifecycles: prompts to workflows, raw documents to stored graphs."""
