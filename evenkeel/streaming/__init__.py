"""Controllers of batch jobs and streams."""
