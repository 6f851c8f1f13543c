"""Panel analytics and corpus operators on PySpark."""
