"""marlstone: analytics for multi-venue market event streams, and corpus operators, on PySpark."""
