"""Column functions: calendars, classes, metrics, and statistics of series held as arrays."""
