"""The list operators on top-level lists (`ordinata.rel.Rel`)."""
