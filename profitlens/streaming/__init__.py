"""The overall reports over a stream of fact files (same plans, Structured Streaming surface)."""
