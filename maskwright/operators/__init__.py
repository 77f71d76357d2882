"""Detection, scoring, conflict resolution and rewriting."""
