"""Bicluster jobs over expression matrices and interaction networks, as Spark DataFrame steps."""
