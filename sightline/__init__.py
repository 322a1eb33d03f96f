"""Spark jobs that turn per-frame annotations of people in videos into social events, timelines and training rows."""
