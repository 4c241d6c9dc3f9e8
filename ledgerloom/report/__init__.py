"""Workpapers: a block model, a language guard, renderers."""
