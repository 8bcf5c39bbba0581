"""Reading reports, logs, commits and push events, and the tables they are kept in."""
