"""Training-data operators: one module for each, their queries in ``registry``."""
