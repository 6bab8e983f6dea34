"""The user-facing analyses, composed from the operators."""
