"""Readers and writers of sequences, k-mer datasets and lists."""
