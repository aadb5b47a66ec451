"""pointweave: event-train, labelled-window and category-enrichment analytics on Spark DataFrames."""
