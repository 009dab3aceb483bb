"""Structured Streaming extensions: files of scans as they arrive, and windows over events."""
