"""Shared distributed building blocks (exact quantiles, ranks, splits,
sufficient statistics, bucketed lag, blocked nearest neighbours)."""
