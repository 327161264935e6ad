"""Column-level helpers; every one compiles to built-in Spark expressions."""
