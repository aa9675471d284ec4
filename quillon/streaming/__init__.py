"""Streams of question events."""
