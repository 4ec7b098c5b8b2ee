"""Readers and writers of sequences, regions, lists and indexes."""
