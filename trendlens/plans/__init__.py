"""Report compositions (the dashboard and job queries) over the operators."""
