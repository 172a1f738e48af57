"""Recurrent networks: genomes, cells, passes over series, training."""
