"""DataFrame operators: index, search, frequencies, statistics, crawl."""
