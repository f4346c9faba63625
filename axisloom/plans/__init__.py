"""Planning: states, steps, costs and policies. Pure Python; nothing here touches data."""
