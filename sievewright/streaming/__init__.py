"""Structured Streaming: mailbox stream, cursors, keyed state."""
