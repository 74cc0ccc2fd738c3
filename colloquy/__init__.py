"""Conversation-archive analytics as Spark jobs."""
