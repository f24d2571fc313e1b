"""Column functions: numbers, dates, text, quantities, money and redaction."""
