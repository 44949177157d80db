"""shelfcast streaming."""
