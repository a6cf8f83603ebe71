"""sources of the conversation-memory engine."""
