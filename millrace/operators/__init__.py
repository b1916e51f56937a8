"""Verbs over collections, each declared as a DataFrame plan."""
