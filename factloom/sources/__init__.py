"""Readers of captured tool output and of text, and sinks."""
