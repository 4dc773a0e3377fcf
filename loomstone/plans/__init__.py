"""Query registry: one entry for each operator."""
