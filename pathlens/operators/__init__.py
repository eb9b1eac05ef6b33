"""DataFrame operators: derived tables, reports, enrichment, factor metrics, insights."""
