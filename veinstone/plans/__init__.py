"""Stages composed of operators, and the runs that chain them."""
