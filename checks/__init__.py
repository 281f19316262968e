"""Registered queries over the driver tables and the equivalent DuckDB SQL."""
