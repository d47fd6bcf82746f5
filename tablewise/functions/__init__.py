"""Column expressions and naming rules shared by every operator."""
