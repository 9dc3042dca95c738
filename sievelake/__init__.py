"""Record screening on Spark: dedup, text screening, venue ranking, audits, decisions."""
