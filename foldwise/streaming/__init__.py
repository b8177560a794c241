"""Streaming form of the training-log monitor (losses arriving epoch by epoch)."""
