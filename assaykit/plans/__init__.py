"""Plans: the normalization gate, table store, replay, retention."""
