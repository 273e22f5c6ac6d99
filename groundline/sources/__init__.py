"""Readers and writers of scenes and cost models."""
