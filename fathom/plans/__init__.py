"""Reusable distributed plan shapes (exact quantiles, global ranks) and the contract query set."""
