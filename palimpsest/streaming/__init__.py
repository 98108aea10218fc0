"""Buffers and processors of turns as they arrive, and the same over tables."""
