"""Rule catalogues: plain data that the operators turn into Spark expressions."""
