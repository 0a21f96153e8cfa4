"""One query per operator over the test tables, with its oracle SQL where SQL can say the same."""
