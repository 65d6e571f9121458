"""See the package README for the module map."""
