"""Stream variants of the intake and snapshot operators."""
