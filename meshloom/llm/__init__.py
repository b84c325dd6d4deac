"""Training-data operators: dedup, quality, mixing, language, leaks, scoring, HTML, URLs, secrets."""
