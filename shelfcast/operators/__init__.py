"""shelfcast operators."""
