"""A versioned wide-column analytics engine on PySpark."""
