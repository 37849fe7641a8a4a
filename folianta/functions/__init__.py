"""Functions of the document engine."""
