"""Conversation, memory, corpus and device analytics as PySpark DataFrame operators."""
