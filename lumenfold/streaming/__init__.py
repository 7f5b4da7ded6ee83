"""Streaming: evaluation in micro-batches that can stop and start anew."""
