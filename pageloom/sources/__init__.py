"""Capture tables in, Markdown corpora out."""
