"""Readers that turn logs, captions and pages into tables."""
