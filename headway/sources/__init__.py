"""Readers, feed parsers and sinks."""
