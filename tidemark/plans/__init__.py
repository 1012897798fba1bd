"""End-to-end jobs and the named query catalog."""
