"""Tables and readers."""
