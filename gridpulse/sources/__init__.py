"""Readers: keyed tables, message streams, JSON metrics and counter text."""
