"""Imports every module that registers queries."""

from undula.plans import q_label, q_scan, q_stream, q_tag, q_window  # noqa: F401
