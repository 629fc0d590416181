"""Inputs: driver tables and media files."""
