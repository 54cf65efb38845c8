"""Plans: multi-step compositions of the operators and the scale helpers they share."""
