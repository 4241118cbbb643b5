"""Structured Streaming counterparts of the batch scans."""
