"""Relational operators: joins, aggregates, graph closures, matching and quality guards."""
