"""Feature families, labels, metrics, simulations and routing over bars."""
