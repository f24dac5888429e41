"""Column functions: text, statistics and the small grammar."""
