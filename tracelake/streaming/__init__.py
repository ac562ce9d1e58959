"""Documents converted as they arrive."""
