"""Plans: layouts searched for, many jobs at once."""
