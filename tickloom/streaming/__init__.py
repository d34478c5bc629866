"""Replay as a stream, and features with state."""
