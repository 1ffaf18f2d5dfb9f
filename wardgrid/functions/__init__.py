"""Column-level building blocks: rule tables, clinical formulas, vectors, report text."""
