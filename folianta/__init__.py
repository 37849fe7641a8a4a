"""Document analytics over DataFrames of pages, text items, comments, fields, outlines and tags."""

__version__ = "0.1.0"
