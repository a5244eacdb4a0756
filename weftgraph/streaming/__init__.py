"""Streams: windowed counts with watermarks and typestate kept per key."""
