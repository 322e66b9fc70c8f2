"""Readers of landed files (JSON listings, pages, sitemaps) into the columns of schema.LISTINGS."""
