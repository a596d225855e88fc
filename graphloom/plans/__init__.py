"""Views and resolution steps between raw tables and the graph operators."""
