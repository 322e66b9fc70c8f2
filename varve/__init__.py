"""Price-history analytics on Spark: change-only logs, peers, scores, specs, search and audits."""
