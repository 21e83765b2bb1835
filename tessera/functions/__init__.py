"""Column-expression helpers (no actions, no driver work)."""
