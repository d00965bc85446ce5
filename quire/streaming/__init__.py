"""The activity log as a stream."""
