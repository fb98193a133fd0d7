"""corpusloom: corpus search and analytics expressed as Spark plans."""
