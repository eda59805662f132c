"""Inputs: source registry, feed payloads, stored tables."""
