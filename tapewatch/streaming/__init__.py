"""The same stages, run on days as they arrive."""
