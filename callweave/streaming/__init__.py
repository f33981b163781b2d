"""The engine is a batch one: there is no streaming operator to offer here."""
