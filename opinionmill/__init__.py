"""Review analytics and text classification as Spark jobs."""
