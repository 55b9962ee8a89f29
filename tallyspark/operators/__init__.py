"""DataFrame -> DataFrame operators, all users at once."""
