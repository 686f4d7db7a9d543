"""Part of the site catalog engine: operators."""
