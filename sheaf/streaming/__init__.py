"""Row-local verbs on Structured Streaming frames."""
