"""Publication-gap analytics as DataFrame plans."""
