"""streaming of the conversation-memory engine."""
