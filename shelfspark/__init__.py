"""Full-text index, ranked search and catalogue analytics as lazy Spark plans."""
