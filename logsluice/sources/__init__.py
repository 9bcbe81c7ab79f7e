"""Readers for request-log lines and outcome tables, batch and streaming."""
