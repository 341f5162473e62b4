"""DataFrame operators over parallel records, predictions, versions and events."""
