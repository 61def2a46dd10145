"""corpusloom.functions."""
