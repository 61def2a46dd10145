"""corpusloom.sources."""
