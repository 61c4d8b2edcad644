"""Part of lodestone; see the package docstring."""
