"""Render and export plans as tables of text."""
