"""Column expressions and closed tables: parsing, units, label rules, vocabulary, text."""
