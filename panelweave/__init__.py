"""panelweave: a Spark-first engine for entity x year panel analytics."""
