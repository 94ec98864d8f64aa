"""Structured Streaming form of the detector and its sinks."""
