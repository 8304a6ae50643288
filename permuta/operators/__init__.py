"""Part of permuta."""
