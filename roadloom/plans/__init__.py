"""Planning: networks, the column grammar, sessions, reports and the command line."""
