"""Multi-omics analytics as ordinary Spark tables and DataFrame operators."""
