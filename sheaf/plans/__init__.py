"""Plan building blocks: row order (bucket + carry), width discovery, sample jobs."""
