"""operators of the conversation-memory engine."""
