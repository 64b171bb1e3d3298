"""Fitted, literal-only plans (preparation) and the EDA module dispatcher."""
