"""Part of meshloom; see the package docstring."""
