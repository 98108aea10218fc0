"""Passes over a memory, their pipeline, and what is generated in the end."""
