"""shelfcast sources."""
