"""Multi-step programs built from the verbs."""
