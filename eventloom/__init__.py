"""Text-event analytics as Spark DataFrame transforms."""
