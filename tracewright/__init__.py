"""Event-graph analytics for security logs, written as DataFrame functions."""
