"""Column helpers: JSON cells, names, text, calendar, network addresses, secrets."""
