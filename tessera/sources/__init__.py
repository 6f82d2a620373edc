"""Where tables and their catalog lie."""
