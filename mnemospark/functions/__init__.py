"""functions of the conversation-memory engine."""
