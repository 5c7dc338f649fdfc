"""DataFrame -> DataFrame operators, grouped as in SURVEY §7.1."""
