"""The analyses: each takes placement tables and parameters and returns a lazy DataFrame."""
