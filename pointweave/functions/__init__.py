"""Column builders: scalar expressions and the per-entity metric registry."""
