"""Column functions: expressions over columns that any operator may use."""
