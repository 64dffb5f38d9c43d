"""Vector, lexical and hybrid retrieval as PySpark DataFrame operators."""
