"""Training-data operators: self-contained, imported by nothing else in the library."""
