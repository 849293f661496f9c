"""Training-data operators: one module per operator, each with a general
interface and the thin query that applies it to the shared tables."""
