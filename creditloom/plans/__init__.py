"""End-to-end feature, score and label jobs built from the operators."""
