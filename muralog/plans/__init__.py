"""Whole reports: operators put together, with shared tables computed once."""
