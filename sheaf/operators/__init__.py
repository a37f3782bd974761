"""Verb implementations; each takes a Wrangler and returns a new one."""
