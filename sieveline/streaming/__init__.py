"""Passes that resume where they stopped."""
