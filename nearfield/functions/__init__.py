"""Column expressions: distances, codes, layout arithmetic, telemetry buckets."""
