"""Part of corpusloom; see the modules."""
