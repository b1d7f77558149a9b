"""End-to-end datasets built from the operators (the pipeline's result tables)."""
