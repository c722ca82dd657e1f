"""The append-only job log as a stream."""
