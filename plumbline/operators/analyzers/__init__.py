"""Heuristic function and structure extraction, by families of languages."""
