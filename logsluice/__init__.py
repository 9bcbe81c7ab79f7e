"""HTTP traffic-log analytics on Spark: decode, filter, sanitize and measure request logs."""

from logsluice.options import JobOptions

__all__ = ["JobOptions"]
