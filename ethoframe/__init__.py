"""Frame-level causal analytics on Spark."""
