"""Labelled property graphs and openCypher queries as DataFrame plans."""
