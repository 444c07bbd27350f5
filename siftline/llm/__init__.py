"""Training-data operators (dedup, mixing, filtering, scoring, auditing)."""
