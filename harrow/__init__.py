"""harrow: retrieval, retrieval evaluation and corpus preparation as lazy Spark plans."""
