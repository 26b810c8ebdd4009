"""folioweave: evidence-graph analytics over bundles of documents, as Spark DataFrame transforms."""
