"""Column expressions: missing-value rules, labels and distribution tails."""
