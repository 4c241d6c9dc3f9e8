"""Full-population ledger testing on Spark."""
