"""Relational operators on sequences, intervals and alignments."""
