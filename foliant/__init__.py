"""Foliant: document-structure analytics on Spark."""
