"""End-to-end plans: ingest, restore, analysis, and the registered queries with their SQL."""
