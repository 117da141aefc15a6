"""digestlake: provenance analytics over content digests, as PySpark DataFrame operators."""
