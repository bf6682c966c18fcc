"""Storage formats and file sources."""
