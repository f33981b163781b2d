"""Call-graph sequence analytics on Spark."""
