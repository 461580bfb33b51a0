"""plinth: search and graph queries over versioned corpora, expressed on Spark DataFrames."""
