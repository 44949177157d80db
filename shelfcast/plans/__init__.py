"""shelfcast plans."""
