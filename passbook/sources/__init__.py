"""Reading landing files and extracted cells; durable tables."""
