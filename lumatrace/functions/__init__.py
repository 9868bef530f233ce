"""Scalar functions: Column in, Column out, inside the JVM wherever built-ins can say it."""
