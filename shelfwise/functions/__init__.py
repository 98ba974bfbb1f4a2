"""Column expressions, rounding, OLS closed forms, exact quantiles and the Student-t tail."""
