"""DataFrame to DataFrame steps. They are lazy, except that windows over stations first measure which
stations are too long for one task."""
