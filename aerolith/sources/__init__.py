"""Readers and writers of the recorded formats."""
