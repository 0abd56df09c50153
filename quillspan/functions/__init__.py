"""Column functions: text, stemming, URLs, HTML."""
