"""Operators for curating document collections and tracking the work around them, as Spark jobs."""
