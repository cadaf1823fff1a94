"""DataFrame operators of the task and code-index engine."""
