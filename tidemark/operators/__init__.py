"""DataFrame-to-DataFrame operators over document, edge, lineage and law tables."""
