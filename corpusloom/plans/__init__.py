"""corpusloom.plans."""
