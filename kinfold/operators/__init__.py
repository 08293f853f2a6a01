"""Stage operators: cleaning, exact copies, near copies, roll-ups, listings."""
