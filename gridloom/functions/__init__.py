"""Column builders: no jobs, no shuffles, usable on streams."""
