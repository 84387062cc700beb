"""Point-in-time analysis of tick, bar and event tables on Spark."""
