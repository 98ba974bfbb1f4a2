"""Named plans (operator + fixture parameters), their DuckDB oracles, and the batch pipeline."""
