"""Registered queries over the driver tables and the end-to-end jobs."""
