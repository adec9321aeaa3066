"""Plan building blocks (size-checked joins, running aggregates) and whole pipelines."""
