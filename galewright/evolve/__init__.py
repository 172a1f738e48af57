"""Evolution of networks: mutation, crossover, populations on islands and in species, transfer to other columns."""
