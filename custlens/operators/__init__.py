"""Table-in / table-out analytic operators."""
