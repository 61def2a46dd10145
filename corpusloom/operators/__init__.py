"""corpusloom.operators."""
