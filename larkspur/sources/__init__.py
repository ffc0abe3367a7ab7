"""Readers and decoders of files."""
