"""Table files as Spark data sources."""
