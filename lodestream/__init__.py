"""Evidence extraction and evaluation on Spark."""
