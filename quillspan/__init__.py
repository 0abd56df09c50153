"""Full-text analytics on Spark: tokenise, stem, index, search, crawl ingest, corpus statistics."""
