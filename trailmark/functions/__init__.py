"""Column functions: every one takes and gives Spark columns and stays in the JVM unless it says otherwise."""
