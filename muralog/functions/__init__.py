"""Column functions: everything here maps columns to a column and stays in the JVM."""
