"""Counting, combining, filtering, reporting and looking up k-mers."""
