"""Captures that keep arriving."""
