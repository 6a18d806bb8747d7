"""Column functions that the operators share."""

from millrace.functions.columns import disc_price, exact, money, money_of, naive_hour

__all__ = ["disc_price", "exact", "money", "money_of", "naive_hour"]
