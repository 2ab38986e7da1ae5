"""DataFrame operators of the research chain."""
