"""Column functions: text, time, scores, payloads of hook events."""
