"""Graph operators over segment tables."""
