"""DataFrame-to-DataFrame operators that the models are composed of."""
