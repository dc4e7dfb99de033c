"""Column functions: scores, text rules, time codes, speed curves."""
