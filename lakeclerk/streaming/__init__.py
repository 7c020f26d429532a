from lakeclerk.streaming.discovery import FULL, INCREMENTAL, read_inventory, scan

__all__ = ["FULL", "INCREMENTAL", "read_inventory", "scan"]
