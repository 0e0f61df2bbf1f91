"""Whole stages composed of the operators."""
