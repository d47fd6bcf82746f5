"""Whole-table plans composed from the operators."""
