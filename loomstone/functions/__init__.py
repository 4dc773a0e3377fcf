"""Column functions: vector math, number text, glob patterns, JSON payload filters, tokens."""
