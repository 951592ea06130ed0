"""Sources: driver tables, payload files, batch submissions, stored tables."""
