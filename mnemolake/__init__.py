"""Agent-memory analytics and corpus preparation on Spark."""
