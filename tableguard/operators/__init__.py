"""The steps that a validation is made of."""
