"""Plans: the query catalogue, its SQL oracle, and the mart pipeline."""
