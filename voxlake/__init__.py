"""Spark jobs for residue-centred protein micro-environments."""
