"""Part of the lectern engine."""
